"""Token-ID output: Parquet files of id lists in document order, and their reader.

One row per document: ``part`` (number of the file in document order), ``doc_id``,
``start_in_part``, ``n_tokens`` and the list column ``ids``. Rows are ordered by ``doc_id`` (then
by text, for repeated ids) within and across files. Ids are dictionary encoded, or delta encoded
in version 2 pages. Row groups and pages have set sizes and the files carry page indexes, so a
reader that filters ``doc_id`` skips pages, and one that wants lengths reads no ids.

Texts of any length are encoded whole, each by one task. NULL or empty texts hold the end id alone. A NULL ``doc_id`` sorts first. An empty table gives no
rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from almanack.llm.common import batches_of_text
from almanack.llm.tokens import ENCODE_BYTES, WordCachedTokenizer

SCHEMA = "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>"
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.writer.version": "v1"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"},
}


def write_token_files(
    docs: DataFrame,
    path: str,
    *,
    tokenizer: str,
    end_id: int = 1,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    part_bytes: int = 128 << 20,
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write them in ``doc_id`` order.

    Texts are dealt by ranges of (doc_id, hash of the text), so a repeated id can be split too. There
    is a range per ``part_bytes`` of text, and at least as many as the session's shuffle partitions, so a
    task's share doesn't grow with the input.
    """
    tie = F.xxhash64("text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(-(-total // part_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = (
        docs.select("doc_id", "text", tie.alias("tie"))
        .repartitionByRange(ranges, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, total = WordCachedTokenizer(tokenizer), TaskContext.get().partitionId(), 0
        for batch, texts in batches_of_text(batches, limit=ENCODE_BYTES):
            flat, ends = coder.encode(texts)
            flat = np.insert(flat, ends[1:], end_id)
            ends = ends + np.arange(len(ends))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(batch), part, np.int32)),
                    batch.column("doc_id"),
                    pa.array(total + ends[:-1]),
                    pa.array(np.diff(ends)),
                    ids,
                ],
                ["part", "doc_id", "start_in_part", "n_tokens", "ids"],
            )
            total += int(ends[-1])

    writer = ordered.mapInArrow(encode, SCHEMA).write.option("compression", "zstd")
    options = ENCODINGS[encoding] | {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes}
    writer.options(**options).parquet(path)


def read_documents(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """Documents of the files with their global ``start``; without ids, no id page is read.

    The row per file is broadcast, so that no id is shuffled.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    rows = rows if with_ids else rows.drop("ids")
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("start_in_part"))


def read_token_range(spark: SparkSession, path: str, first_id: int, last_id: int) -> DataFrame:
    """``doc_id`` and ``ids`` of an id range; page indexes keep other pages unread."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.where(F.col("doc_id").between(first_id, last_id)).select("doc_id", "ids")


def with_checksums(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``: CRC-32 of the ids as little-endian unsigned 32-bit."""
    kept = [c for c in rows.columns if c != "ids"]

    def crc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.asarray(lists.offsets)
            values = np.asarray(lists.values).astype("<u4")
            sums = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [batch.column(c) for c in kept] + [pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "ids_crc32"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(kept).schema)
    return rows.mapInArrow(crc, f"{fields}, ids_crc32 long")
