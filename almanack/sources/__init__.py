from almanack.sources.delimited import (
    Reading,
    list_files,
    read_checked,
    read_glob,
    read_guessed,
    read_records,
    read_typed,
    read_typed_years,
    read_with_origin,
    read_years,
)
from almanack.sources.headers import adopt_header, below_header, clean_names, conform, snake
from almanack.sources.html import cell_text, html_cell, html_grid_cell
from almanack.sources.lookups import STUDENT_GROUPS, literal_table, student_groups
from almanack.sources.sinks import editions, publish_edition, read_editions, write_chart_rows, write_report_table
from almanack.sources.tables import load_table, stage_table

__all__ = [
    "Reading",
    "STUDENT_GROUPS",
    "adopt_header",
    "below_header",
    "cell_text",
    "clean_names",
    "conform",
    "editions",
    "html_cell",
    "html_grid_cell",
    "list_files",
    "literal_table",
    "load_table",
    "publish_edition",
    "read_checked",
    "read_editions",
    "read_glob",
    "read_guessed",
    "read_records",
    "read_typed",
    "read_typed_years",
    "read_with_origin",
    "read_years",
    "snake",
    "stage_table",
    "student_groups",
    "write_chart_rows",
    "write_report_table",
]
