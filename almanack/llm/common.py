"""Helpers shared by the operators: staged tables, bounded slices of a batch, hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at a time, whatever the size of the Arrow batch.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can read and write.

    Only a local session may do without that setting; it then gets a scratch folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="almanack-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there.

    The shuffle files of the finished job are released, as nothing refers to them any more.
    """
    spark = df.sparkSession
    path, schema = shared_folder(spark, what), df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    release(spark)
    frame = spark.read.schema(schema).parquet(path)
    frame.staged_path = path
    return frame


def discard(*frames: DataFrame) -> None:
    """Delete staged tables. Only for tables whose successors are all written, so that no lost task needs them."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.staged_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs whose frames are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """In a Python worker: return the memory that earlier stages of the same worker have left behind."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


Batches = Iterable[pa.RecordBatch]


def tidy(run: Callable[[Batches], Iterator[pa.RecordBatch]]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """The function of a task, which leaves none of its memory to the worker's later stages."""

    def tidied(batches: Batches) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def smallest(df: DataFrame, by: str, most: int) -> DataFrame:
    """The rows with the ``most`` smallest values of ``by`` (more only where values are equal).

    Only that column is ranked, so no task sends whole rows to the driver.
    """
    last = df.select(by).orderBy(by).limit(most).agg(F.max(by)).first()[0]
    return df.where(F.lit(False)) if last is None else df.where(F.col(by) <= last)


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row is a range of its own."""
    start, total = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield start, row
            start, total = row, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def batches_of_text(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut Arrow batches into slices of bounded text; gives each slice and its texts, NULL as ''."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column).cast(pa.string()), "")
        sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
        for start, stop in slices(sizes, limit):
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, one after the other, and the offset of each text."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, (offsets - offsets[0]).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1


def _prefix_sums(data: np.ndarray, seed: int) -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03 + 2 * seed))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _powers(BASE, len(data)), out=sums[1:])
    return sums


def spans_hash(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each ``data[start:stop]``; equal bytes give equal hashes in any batch.

    Polynomial prefix sums modulo 2**64 over mixed byte values, so the cost is one pass over the
    bytes however long or overlapping the spans are.
    """
    with np.errstate(over="ignore"):
        sums = _prefix_sums(data, seed)
        inverse = _powers(pow(BASE, -1, 1 << 64), len(data) + 1)
        raw = (sums[stops] - sums[starts]) * inverse[starts]
        return mix64(raw ^ mix64((stops - starts).astype(np.uint64) + np.uint64(seed)))


def grams_hash(data: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """``spans_hash`` of every ``width`` bytes in a row, which as slices take less time than as places."""
    with np.errstate(over="ignore"):
        sums = _prefix_sums(data, seed)
        raw = sums[width:] - sums[:-width]
        raw *= _powers(pow(BASE, -1, 1 << 64), len(raw))
        return mix64(raw ^ mix64(np.full(1, width + seed, np.uint64)))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept for the worker's life."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            with np.errstate(over="ignore"):
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if n <= 2 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]
