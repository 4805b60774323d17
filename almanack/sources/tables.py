"""Published tables: catalog, Parquet folder or database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def load_table(
    spark: SparkSession,
    name: str,
    root: str | None = None,
    jdbc: Mapping[str, str] | None = None,
) -> DataFrame:
    """A lazy scan of a named table; filters and column choices reach the source.

    ``root`` reads ``root/name.parquet``. ``jdbc`` holds Spark's JDBC options; give
    partitionColumn, lowerBound, upperBound and numPartitions for a parallel read.
    Otherwise the session catalog is used.
    """
    if jdbc is not None:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    if root is not None:
        return spark.read.parquet(f"{root}/{name}.parquet")
    return spark.table(name)


def stage_table(df: DataFrame, path: str, by: str = "academic_year") -> None:
    """Write a table partitioned by year, so that a latest-year filter prunes partitions."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
