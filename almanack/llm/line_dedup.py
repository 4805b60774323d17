"""Line dedup against levelled sorted runs of line hashes (DataFrame functions only).

An index is a list of runs: tables of (h1, h2, doc_id), bucketed and sorted by the hash, one row
per line key with the smallest document that held it. Documents arrive in batches of ascending
``doc_id``. A batch merge-joins its line keys with the runs; a line whose key an earlier document
holds, in the runs or in the batch, goes, and keys that the runs don't know become a new run of
level 0. Once a level has ``fan_out`` runs they are merged into one of the next level, so there
are only a logarithmic number of runs, and no run is sorted again when it is read.

A key is the line without white space (space, \\t to \\r) at both ends and with A-Z in lower
case; shorter keys than ``min_length`` code points always stay. A NULL text counts as one empty
line; an empty table gives no rows. Rows without ``doc_id`` are kept as they are and give no keys.
Repeated rows of one ``doc_id`` are one document and keep their lines. Hashes are 128 bits wide.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.llm.common import shared_folder, staged

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; the quick function where all is ASCII."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


@dataclass
class LineRuns:
    """The runs of one index; ``levels[i]`` lists the folders of level i."""

    spark: SparkSession
    fan_out: int = 4
    buckets: int | None = None
    levels: list[list[str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def run_names(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def first_holders(self, keys: DataFrame) -> DataFrame:
        """h1, h2, first: for each distinct key of ``keys`` the document of the runs that holds it."""
        for n, run in enumerate(self.run_names()):
            held = self.spark.table(run).withColumnRenamed("doc_id", f"held{n}")
            keys = keys.join(held, ["h1", "h2"], "left")
        names = [f"held{n}" for n in range(len(self.run_names()))]
        first = F.coalesce(*names) if names else F.lit(None).cast("long")
        return keys.withColumn("first", first).drop(*names)

    def add(self, keys: DataFrame) -> None:
        """Add a run of new keys (h1, h2, doc_id), then merge full levels."""
        self._insert(0, self._write(keys))

    def _insert(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0])
            for run in old[1:]:
                merged = merged.unionByName(self.spark.table(run))
            self._insert(level + 1, self._write(merged))
            for run in old:
                self.spark.sql(f"DROP TABLE {run}")

    def _write(self, keys: DataFrame) -> str:
        path = shared_folder(self.spark, "line-run")
        name = "line_run_" + path.rpartition("-")[2]
        (
            keys.select("h1", "h2", "doc_id")
            .repartition(self.buckets, "h1", "h2")
            .write.bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .option("path", path)
            .format("parquet")
            .saveAsTable(name)
        )
        return name

    def close(self) -> None:
        """Take the runs out of the session's catalogue."""
        for run in self.run_names():
            self.spark.sql(f"DROP TABLE {run}")
        self.levels = []


def keyed_lines(docs: DataFrame, min_length: int) -> DataFrame:
    """doc_id, h1, h2: the distinct hashed keys of each document's long lines."""
    stripped = F.transform(
        lines_of(ascii_lower(F.col("text"))), lambda line: F.btrim(line, F.lit(BLANKS))
    )
    long_ones = F.filter(stripped, lambda line: F.length(line) >= min_length)
    keys = docs.where("doc_id IS NOT NULL").select("doc_id", F.explode(F.array_distinct(long_ones)).alias("key"))
    return keys.select(
        "doc_id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")
    )


def repeated_lines(docs: DataFrame, runs: LineRuns, *, min_length: int = 10) -> DataFrame:
    """doc_id, h1, h2 of the lines that one batch has to lose; its new keys join the runs."""
    keys = staged(keyed_lines(docs, min_length), "line-keys")
    firsts = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    firsts = staged(runs.first_holders(firsts), "line-firsts")
    runs.add(firsts.where("first IS NULL"))
    # Only keys that some document must lose meet the lines again.
    known = firsts.select("h1", "h2", F.coalesce("first", "doc_id").alias("first"), "last")
    known = known.where("last > first").drop("last")
    return keys.join(known, ["h1", "h2"]).where("doc_id > first").select("doc_id", "h1", "h2")


def batches_by_id(docs: DataFrame, batches: int) -> list[tuple[int, int]]:
    """Ranges of ``doc_id`` of about as many rows each, in ascending order, covering all rows."""
    shares = [i / batches for i in range(1, batches)]
    low, high, *cuts = docs.agg(
        F.min("doc_id"), F.max("doc_id"), *[F.percentile_approx("doc_id", F.lit(q)) for q in shares]
    ).first()
    if low is None:
        return []
    edges = [low, *sorted({c + 1 for c in cuts if c < high}), high + 1]
    return list(zip(edges[:-1], edges[1:], strict=True))


def dedup_lines(docs: DataFrame, *, batches: int = 4, fan_out: int = 3, min_length: int = 10) -> DataFrame:
    """All columns of ``docs`` with the kept lines in ``text``, and ``n_lines`` and ``n_dropped``.

    A key found in several documents keeps its lines only in the smallest ``doc_id``. A NULL text
    becomes an empty one. Input columns of the two new names are replaced.
    """
    runs = LineRuns(docs.sparkSession, fan_out)
    lost = None
    for low, high in batches_by_id(docs, batches):
        part = repeated_lines(docs.where(F.col("doc_id").between(low, high - 1)), runs, min_length=min_length)
        part = staged(part, "line-losses")
        lost = part if lost is None else lost.unionByName(part)
    runs.close()
    lines = lines_of(F.col("text"))
    if lost is None:
        return docs.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": F.lit(0).cast("long")})
    per_doc = lost.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("__lost"))
    joined = docs.join(per_doc, "doc_id", "left").withColumn("__lines", lines)

    def stays(line: Column) -> Column:
        key = F.btrim(ascii_lower(line), F.lit(BLANKS))
        hashed = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))
        return ~F.coalesce(F.array_contains("__lost", hashed), F.lit(False))

    kept = F.when(F.col("__lost").isNull(), F.col("__lines")).otherwise(F.filter("__lines", stays))
    joined = joined.withColumn("__kept", kept)
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(
        *[F.col(f"`{c}`") if c != "text" else F.concat_ws("\n", "__kept").alias("text") for c in others],
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
    )
