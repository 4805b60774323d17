"""Left joins to code lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.sources.lookups import student_groups


def group_names(df: DataFrame, first_edition: bool = False) -> DataFrame:
    """Add student_group for each reporting_category; unknown codes keep a NULL.

    The lookup is a literal of at most 20 rows, so broadcasting it is always safe.
    """
    lookup = student_groups(df.sparkSession, first_edition)
    return df.join(F.broadcast(lookup), "reporting_category", "left")


def codebook_definitions(
    df: DataFrame, codebook: DataFrame, table: str, column: str, name: str = "student_group"
) -> DataFrame:
    """Add the codebook's definition of a coded column.

    Codes are compared as text. The codebook comes from outside and may be of any size, so
    no broadcast is forced: Spark measures the filtered side and broadcasts it only below
    its threshold, and otherwise shuffles on the code with skew handling.
    """
    book = codebook.where(F.col("table") == table).select(
        F.col("value").cast("string").alias("_code"), F.col("definition").alias(name)
    )
    return df.join(book, df[column].cast("string") == book["_code"], "left").drop("_code")
