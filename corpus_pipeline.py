"""The corpus pipeline: five stages over documents, each a table written before the next begins.

Every stage reads all that its predecessor kept, and all but the last return the columns of
documents. Rows without ``doc_id`` are never taken for a copy or a leak, so they go through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.llm import toxicity
from almanack.llm.common import staged, table
from almanack.llm.decontaminate import contaminated
from almanack.llm.line_dedup import dedup_lines
from almanack.llm.near_dedup import near_duplicates
from almanack.llm.packing import PIECE, pack
from almanack.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model).where("toxicity < 0.5").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; ``n_chars`` follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity of 0.8 or more."""
    copies = near_duplicates(docs, words=5, num=4, den=5).where("NOT kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in token sequences; small slices, as the workers still hold earlier stages' models."""
    return pack(docs, tokenizer=TOKENIZER, encode_bytes=2 << 20).select(PIECE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages hold models and a tokenizer, which SQL can't express; tests hold the run against plain Python.
ORACLE_SQL = None
