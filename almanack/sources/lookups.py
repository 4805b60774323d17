"""Literal tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# Reporting category codes and the student groups they stand for.
STUDENT_GROUPS = [
    ("RB", "African American"),
    ("RI", "American Indian or Alaska Native"),
    ("RA", "Asian"),
    ("RF", "Filipino"),
    ("RH", "Hispanic or Latino"),
    ("RD", "Race Not Reported"),
    ("RP", "Pacific Islander"),
    ("RT", "Two or More Races"),
    ("RW", "White"),
    ("GM", "Male"),
    ("GF", "Female"),
    ("GX", "Non-Binary"),
    ("GZ", "Missing Gender"),
    ("SE", "English Learners"),
    ("SD", "Students with Disabilities"),
    ("SS", "Socioeconomically Disadvantaged"),
    ("SM", "Migrant"),
    ("SF", "Foster"),
    ("SH", "Homeless"),
    ("TA", "Total"),
]

# Codes the first edition's lookup does not have.
_LATER_CODES = {"GX", "GZ"}


def literal_table(spark: SparkSession, rows: Sequence[tuple[Any, ...]], schema: str) -> DataFrame:
    """A table written out in the program.

    Handed over as an Arrow table it becomes a local relation, whose size the optimizer
    knows exactly; a list of tuples would be a scan of unknown size.
    """
    fields = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    table = pa.table(
        [pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(columns, fields, strict=True)],
        names=fields.names,
    )
    return spark.createDataFrame(table, schema=fields)


def student_groups(spark: SparkSession, first_edition: bool = False) -> DataFrame:
    """reporting_category, student_group: 20 rows, or the 18 of the first edition."""
    rows = [r for r in STUDENT_GROUPS if not (first_edition and r[0] in _LATER_CODES)]
    return literal_table(spark, rows, "reporting_category string, student_group string")
