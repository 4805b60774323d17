"""Where results go: chart rows and formatted tables."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.sources.lookups import literal_table

MANIFEST = "report_year string, edition string, made bigint, rows bigint"


def write_chart_rows(df: DataFrame, path: str, report_year: str) -> None:
    """Write chart rows under report_year=/figure=, each figure one file with its series sorted by x.

    Only the figures present are replaced, so editions share a folder without overwriting
    one another.
    """
    (
        df.withColumn("report_year", F.lit(report_year))
        .repartition("report_year", "figure")
        .sortWithinPartitions("report_year", "figure", "series", "x")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("report_year", "figure")
        .parquet(path)
    )


def write_report_table(df: DataFrame, path: str) -> None:
    """Write a table of display texts as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def publish_edition(df: DataFrame, path: str, report_year: str) -> str:
    """Replace a report year as a whole; gives the name of the new edition.

    The rows go to a folder of their own. Only when all of them are there does a line of the manifest, itself
    written in one step, name the folder. A write that fails half way leaves a folder that no line names, and readers
    keep the edition before.
    """
    spark, edition = df.sparkSession, uuid.uuid4().hex
    folder = f"{path}/editions/{edition}"
    write_chart_rows(df, folder, report_year)
    rows = spark.read.parquet(folder).count()
    line = literal_table(spark, [(report_year, edition, time.time_ns(), rows)], MANIFEST)
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return edition


def editions(spark: SparkSession, path: str) -> DataFrame:
    """report_year, edition, made, rows: the newest complete edition of each report year."""
    try:
        lines = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return literal_table(spark, [], MANIFEST)
    newest = F.max_by(F.struct("edition", "made", "rows"), F.struct("made", "edition")).alias("newest")
    return lines.groupBy("report_year").agg(newest).select("report_year", "newest.*")


def read_editions(spark: SparkSession, path: str, report_year: str | None = None) -> DataFrame:
    """Chart rows of the newest edition of every report year, or of one; lost or added rows are an error."""
    found = editions(spark, path)
    found = found if report_year is None else found.where(F.col("report_year") == report_year)
    lines = found.orderBy("report_year").collect()  # a row per report year
    if not lines:
        raise ValueError(f"no edition under {path}" + (f" for {report_year}" if report_year else ""))
    folders = [f"{path}/editions/{r.edition}" for r in lines]
    frames = [spark.read.parquet(f).withColumn("report_year", F.lit(r.report_year)) for f, r in zip(folders, lines, strict=True)]
    for frame, r in zip(frames, lines, strict=True):
        if frame.count() != r.rows:
            raise ValueError(f"edition {r.edition} of {r.report_year} has other rows than it was published with")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
