"""One cell of an HTML table, by position.

``html_cell`` counts the cells of a row as they are written, ``html_grid_cell`` finds the cell that covers a place of the
table's grid, where cells may span rows and columns. Markup is matched flat, with no nesting of the same
tag; fetching pages is not done here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanack.functions.logic import _col


def _nth(c: Column, tag: str, n: int) -> Column:
    """Inner markup of the n-th element with this tag (a regex alternative), from 1."""
    pattern = rf"(?is)<(?:{tag})(?:\s[^>]*)?>(.*?)</(?:{tag})>"
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(n - 1))


def cell_text(markup: Column) -> Column:
    """Visible text: tags out, the common entities resolved, ends trimmed."""
    text = F.regexp_replace(markup, r"(?s)<[^>]*>", "")
    # Entities that occur in number and name cells; &amp; comes last.
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


def html_cell(
    html: Column | str,
    row: int,
    cell: int,
    block: int = 1,
    block_tag: str = "table",
    row_tag: str | None = "tr",
    cell_tag: str = "t[dh]",
) -> Column:
    """Text of the cell-th cell in the row-th row of the block-th block; NULL if absent.

    With ``row_tag=None`` the cells sit directly in the block, as in a list.
    """
    inner = _nth(_col(html), block_tag, block)
    if row_tag is not None:
        inner = _nth(inner, row_tag, row)
    return cell_text(_nth(inner, cell_tag, cell))


def _span(attributes: Column, name: str, most: int) -> Column:
    """A span attribute as a number; missing and malformed ones are 1, too large ones the most that HTML allows."""
    text = F.regexp_extract(attributes, rf"""(?i)(?:^|\s){name}\s*=\s*["']?\s*(\d{{1,9}})""", 1)
    number = F.nullif(text, F.lit("")).try_cast("int")  # a failed cast costs far more than the search
    return F.least(F.coalesce(number, F.lit(1)), F.lit(most))


def _cells(row: Column) -> Column:
    """wide, high and markup of the cells of a row; a height of 0 reaches to the end of the table."""
    pattern = F.lit(r"(?is)<t[dh](\s[^>]*)?>(.*?)</t[dh]>")
    pairs = F.arrays_zip(
        F.regexp_extract_all(row, pattern, F.lit(1)).alias("attributes"), F.regexp_extract_all(row, pattern, F.lit(2)).alias("inner")
    )
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.greatest(_span(p["attributes"], "colspan", 1_000), F.lit(1)).alias("wide"),
            _span(p["attributes"], "rowspan", 65_534).alias("high"),
            p["inner"].alias("markup"),
        ),
    )


def html_grid_cell(
    html: Column | str, row: int, column: int, block: int = 1, block_tag: str = "table", header: bool | None = None
) -> Column:
    """Text of the cell that covers a place of the block-th table's grid; NULL if none does.

    A cell starts in the first column of its row that no cell from above covers, and spans columns and rows from
    there; of two cells on one place, the one of the lower row counts. Rows count from 1 behind a header. By
    default the first row is one if it has only header cells.
    """
    pattern = F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>")
    rows = F.regexp_extract_all(_nth(_col(html), block_tag, block), pattern, F.lit(1))
    headed = lambda top: F.lit(header) if header is not None else top.rlike(r"(?i)<th[\s>]") & ~top.rlike(r"(?i)<td[\s>]")
    grid = "array<struct<left:int,markup:string>>"
    start = F.struct(F.array().cast(grid).alias("above"), F.lit(1).alias("row"), F.lit(None).cast("string").alias("found"))

    def still_held(above: Column, first: Column, count: Column) -> Column:
        """Columns from above in a row that writes nothing there."""
        return F.transform(
            F.slice(above, first + 1, count),
            lambda h: F.struct(F.greatest(h["left"] - 1, F.lit(0)).alias("left"), F.when(h["left"] > 0, h["markup"]).alias("markup")),
        )

    def line_of(above: Column, cells: Column) -> Column:
        """left, markup per column of a row: for how many more rows its cell counts, and what it holds."""
        held = lambda i: F.coalesce(F.get(above, i)["left"], F.lit(0)) > 0

        def put(line: Column, c: Column) -> Column:
            behind = F.filter(F.sequence(F.size(line), F.greatest(F.size(above), F.size(line))), lambda i: ~held(i))
            skipped = F.when(held(F.size(line)), F.get(behind, F.lit(0)) - F.size(line)).otherwise(0)
            more = F.when(c["high"] == 0, 65_534).otherwise(c["high"]) - 1
            own = F.array_repeat(F.struct(more.alias("left"), c["markup"].alias("markup")), c["wide"])
            return F.concat(line, still_held(above, F.size(line), skipped), own)

        written = F.aggregate(cells, F.array().cast(grid), put)
        rest = lambda line: F.concat(line, still_held(above, F.size(line), F.size(above)))
        return F.get(F.transform(F.array(written), rest), F.lit(0))

    def step(wanted: Column, s: Column, markup: Column) -> Column:
        return F.get(
            F.transform(
                F.array(line_of(s["above"], _cells(markup))),
                lambda line: F.struct(
                    line.alias("above"),
                    (s["row"] + 1).alias("row"),
                    F.when(s["row"] == wanted, F.get(line, F.lit(column - 1))["markup"]).otherwise(s["found"]).alias("found"),
                ),
            ),
            F.lit(0),
        )

    def find(table: Column) -> Column:
        wanted = F.when(headed(F.get(table["rows"], F.lit(0))), row + 1).otherwise(row)
        walked = F.transform(F.array(wanted), lambda w: F.aggregate(table["rows"], start, lambda s, m: step(w, s, m), lambda s: s["found"]))
        return F.get(walked, F.lit(0))

    # Each is worked out once: the rows that matter, then the row that is wanted.
    top = F.struct(F.slice(rows, F.lit(1), F.lit(row + 1)).alias("rows"))
    return F.btrim(cell_text(F.get(F.transform(F.array(top), find), F.lit(0))), F.lit(" \t\n\f\r"))
