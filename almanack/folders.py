"""Tables that outlive the job that makes them, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a local session may do without that setting; it then gets a scratch folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="almanack-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The same rows as a table: it is worked out once, and its lineage ends there."""
    spark, schema = df.sparkSession, df.schema
    path = shared_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
