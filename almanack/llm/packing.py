"""Packing documents into token sequences by cutting-stock column generation.

Lengths are counted in a histogram of ``classes`` length classes. A linear program over patterns
(how many documents of each class share a sequence) is solved by column generation, where a
knapsack dynamic program prices new patterns. Rounded-down pattern counts give slots; documents
take slots by their rank within their class, which is arithmetic on a small table of slot ranges.
Documents beyond the slots form one stream of tokens that is cut to fill the sequences' remaining
space, and then whole sequences; the last tokens form sequences whose lengths are powers of two.

Documents of ``size`` tokens and more first give whole sequences; only their rest is packed. A
NULL or empty text is the end id alone. A NULL ``doc_id`` is packed like any other. Repeated rows
are packed once each. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from almanack.llm.common import batches_of_text, give_back, staged, tidy
from almanack.llm.tokens import ENCODE_BYTES, WordCachedTokenizer

#: Tokens of the filling stream that one group of rows covers when it is cut.
BLOCK = 1 << 18
KEYS = (F.xxhash64, lambda *c: F.xxhash64(F.lit(7), *c))

PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


# ---------------------------------------------------------------- the linear program


def price(values: np.ndarray, units: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best pattern for the given class values: an unbounded knapsack by dynamic programming."""
    worth = values > 1e-12
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    u, v, names = units[worth], values[worth], np.flatnonzero(worth)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = u <= room
        if fits.any():
            options = np.where(fits, best[np.maximum(room - u, 0)] + v, -1.0)
            k = int(options.argmax())
            if options[k] > best[room] + 1e-15:
                best[room], choice[room] = options[k], names[k]
    pattern, room = np.zeros(len(values)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= units[choice[room]]
    return float(best[capacity]), pattern


def patterns_for(demand: np.ndarray, units: np.ndarray, capacity: int, gap: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often to use each, fractional, to cover the demand exactly.

    Revised simplex with an explicit inverse; starts from patterns of one class each. The number of
    sequences divided by the best price is a lower bound of the optimum; the search ends within
    ``gap`` of it, or within half a sequence.
    """
    m = len(demand)
    columns = np.diag(capacity // units).astype(float)
    inverse, amounts = np.diag(1 / np.diag(columns)), demand / np.diag(columns)
    for turn in range(60 * m + 500):
        value, entering = price(inverse.sum(axis=0), units, capacity)
        if value <= 1 + gap or amounts.sum() * (1 - 1 / value) < 0.5:
            break
        direction = inverse @ entering
        ratios = np.where(direction > 1e-10, np.maximum(amounts, 0) / np.where(direction > 1e-10, direction, 1), np.inf)
        leaving = int(ratios.argmin())
        step = ratios[leaving]
        amounts = amounts - step * direction
        amounts[leaving] = step
        columns[:, leaving] = entering
        inverse[leaving] /= direction[leaving]
        rest = np.arange(m) != leaving
        inverse[rest] -= np.outer(direction[rest], inverse[leaving])
        if turn % 400 == 399:
            inverse = np.linalg.inv(columns)
            amounts = inverse @ demand
    return columns.T, np.maximum(amounts, 0)


def rounded(patterns: np.ndarray, amounts: np.ndarray, demand: np.ndarray, means: np.ndarray, size: int) -> np.ndarray:
    """Whole pattern counts, as large as leave enough documents over to fill the sequences' space."""

    def counts(share: float) -> np.ndarray:
        return np.floor(share * amounts + 1e-9)

    def enough(share: float) -> bool:
        used = counts(share)
        slots = used @ patterns
        space = used.sum() * size - slots @ means
        return bool((slots <= demand).all() and (demand - slots) @ means >= 1.005 * space + 64 * size)

    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if enough(middle) else (low, middle)
    return counts(low).astype(np.int64)


# ---------------------------------------------------------------- tokens


def measured(docs: DataFrame, tokenizer: str, end_id: int, size: int, encode_bytes: int) -> DataFrame:
    """doc_id, k1, k2 (a key of the row), n (tokens), crcs (of each whole sequence and of the rest)."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        coder = WordCachedTokenizer(tokenizer)
        for batch, texts in batches_of_text(batches, limit=encode_bytes):
            flat, ends = coder.encode(texts)
            flat = np.insert(flat, ends[1:], end_id).astype("<u4")
            ends = ends + np.arange(len(ends))
            sums = [[zlib.crc32(flat[i : min(i + size, b)]) for i in range(a, b, size)] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(np.diff(ends)), pa.array(sums, pa.list_(pa.int64()))],
                ["doc_id", "k1", "k2", "n", "crcs"],
            )

    return keyed(docs).mapInArrow(tidy(measure), "doc_id long, k1 long, k2 long, n long, crcs array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", KEYS[0]("doc_id", "text").alias("k1"), KEYS[1]("text", "doc_id").alias("k2"))


def cut_checksums(docs: DataFrame, cuts: DataFrame, tokenizer: str, end_id: int, encode_bytes: int) -> DataFrame:
    """The cut pieces with the checksum of their ids; only documents that were cut are read again."""
    fields = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    lists = cuts.groupBy("k1", "k2").agg(F.collect_list(F.struct("doc_id", *fields)).alias("cuts"))
    texts = keyed(docs).groupBy("k1", "k2").agg(F.first("text").alias("text"))

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCachedTokenizer(tokenizer)
        for batch, found in batches_of_text(batches, limit=encode_bytes):
            flat, ends = coder.encode(found)
            flat = np.insert(flat, ends[1:], end_id).astype("<u4")
            begins = (ends + np.arange(len(ends))).tolist()
            rows = []
            for begin, cuts_of in zip(begins, batch.column("cuts").to_pylist(), strict=False):
                for x in cuts_of:
                    first = begin + x["start"]
                    rows.append(x | {"ids_crc32": zlib.crc32(flat[first : first + x["length"]])})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.int64()) for c in PIECE]))

    return lists.join(texts, ["k1", "k2"]).select("text", "cuts").mapInArrow(tidy(sums), ", ".join(f"`{c}` long" for c in PIECE))


# ---------------------------------------------------------------- ranks and running totals


def running(rows: DataFrame, value: Column, name: str, *, within: list[str], order: list[str]) -> DataFrame:
    """Add the total of ``value`` over all earlier rows of the same ``within``.

    The order is by a hash bucket first, so that a large group is spread over all buckets: totals
    of buckets are summed once, and each bucket's rows on their own.
    """
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumns({"__bucket": F.pmod(F.xxhash64(F.lit(11), *order), F.lit(buckets)), "__value": value})
    in_bucket = Window.partitionBy(*within, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over_buckets = Window.partitionBy(*within).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*within, "__bucket").agg(F.sum("__value").alias("__total"))
    totals = totals.select(*within, "__bucket", F.coalesce(F.sum("__total").over(over_buckets), F.lit(0)).alias("__base"))
    rows = rows.withColumn("__here", F.coalesce(F.sum("__value").over(in_bucket), F.lit(0)))
    rows = rows.join(totals, [*within, "__bucket"])
    return rows.withColumn(name, F.col("__base") + F.col("__here")).drop("__bucket", "__value", "__base", "__here")


# ---------------------------------------------------------------- packing


def pack(
    docs: DataFrame, *, tokenizer: str, end_id: int = 2, size: int = 4096, classes: int = 128, encode_bytes: int = ENCODE_BYTES
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``encode_bytes`` of text are encoded at a time; a smaller number spares memory of the Python workers.
    """
    spark, width = docs.sparkSession, size // classes
    rows = staged(measured(docs, tokenizer, end_id, size, encode_bytes), "lengths")
    rest = F.col("n") % size
    items = rows.where(rest > 0).select(
        "doc_id", "k1", "k2", "n", rest.alias("rest"), F.element_at("crcs", -1).alias("crc"),
        F.ceil(rest / width).cast("int").alias("class"),
    )
    histogram = sorted(items.groupBy("class").agg(F.count("*"), F.sum("rest")).collect())  # a row per class
    slots, used_sequences = slot_ranges(histogram, size, classes)

    # Documents of a whole sequence and more.
    whole = running(rows.where(F.col("n") >= size), F.floor(F.col("n") / size), "__first", within=[], order=["k1", "k2"])
    whole = whole.select("doc_id", "n", "__first", F.posexplode(F.slice("crcs", 1, F.floor(F.col("n") / size).cast("int"))).alias("i", "crc"))
    whole = whole.select(
        "doc_id", (F.col("i") * F.lit(size).cast("long")).alias("start"), F.lit(size).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("__first") + F.col("i")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    whole_count = rows.agg(F.coalesce(F.sum(F.floor(F.col("n") / size)), F.lit(0))).first()[0]

    # Ranked documents take the slots of their class.
    ranked = running(items, F.lit(1), "rank", within=["class"], order=["k1", "k2"])
    names = ["class", "low", "high", "each", "base", "slot"]
    table = arrow_frame(spark, names, slots or [(0, 0, 0, 1, 0, 0)])
    table = F.broadcast(table)  # at most a row per pattern and class
    place = (ranked["class"] == table["class"]) & (ranked["rank"] >= table["low"]) & (ranked["rank"] < table["high"])
    ranked = staged(ranked.join(table, place, "left").drop("class"), "ranked")
    at = F.col("rank") - F.col("low")
    placed = ranked.where("low IS NOT NULL").select(
        "doc_id", "k1", "k2", "n", "rest", "crc",
        (F.col("base") + F.floor(at / F.col("each")) + F.lit(whole_count)).alias("sequence_id"),
        (F.col("slot") + at % F.col("each")).alias("slot"),
    )
    earlier = Window.partitionBy("sequence_id").orderBy("slot", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    fitted = placed.select(
        "doc_id", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), "sequence_id", F.coalesce(F.sum("rest").over(earlier), F.lit(0)).alias("offset"),
    )

    # The others fill what is left of the sequences, then new ones.
    space = placed.groupBy("sequence_id").agg(F.sum("rest").alias("used")).where(F.col("used") < size)
    space = running(space, F.lit(size) - F.col("used"), "low", within=[], order=["sequence_id"])
    space = space.select("sequence_id", F.col("used").alias("inside"), "low", (F.col("low") + size - F.col("used")).alias("high"))
    stream = running(ranked.where("low IS NULL"), F.col("rest"), "at", within=[], order=["k1", "k2"])
    stream = staged(stream.select("doc_id", "k1", "k2", "n", "rest", "crc", "at"), "stream")
    total = stream.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0]
    room = staged(space, "space")
    filled = room.agg(F.coalesce(F.max("high"), F.lit(0))).first()[0]
    pieces = filling(stream, new_sequences(room, filled, total, whole_count + used_sequences, size), total)
    is_whole = F.col("length") == F.col("rest")
    entire = pieces.where(is_whole).select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    cuts = pieces.where(~is_whole).select("doc_id", "k1", "k2", "start", "length", "doc_tokens", "sequence_id", "offset")
    cut = cut_checksums(docs, cuts, tokenizer, end_id, encode_bytes)
    return whole.unionByName(fitted).unionByName(entire).unionByName(cut)


def slot_ranges(histogram: list, size: int, classes: int) -> tuple[list[tuple[int, ...]], int]:
    """(class, low, high, each, base, slot): documents of a class by rank, and the sequences used."""
    if not histogram:
        return [], 0
    units = np.array([h[0] for h in histogram])
    demand, totals = (np.array([float(h[i]) for h in histogram]) for i in (1, 2))
    patterns, amounts = patterns_for(demand, units, classes)
    counts = rounded(patterns, amounts, demand, totals / demand, size)
    taken, ranges, base = np.zeros(len(units), np.int64), [], 0
    for pattern, count in zip(patterns.astype(np.int64), counts.tolist(), strict=True):
        slot = 0
        for k in np.flatnonzero(pattern) if count else ():
            each = int(pattern[k])
            ranges.append((int(units[k]), int(taken[k]), int(taken[k]) + each * count, each, base, slot))
            taken[k] += each * count
            slot += each
        base += count
    return ranges, base


def new_sequences(space: DataFrame, filled: int, total: int, first: int, size: int) -> DataFrame:
    """The space left in sequences, and sequences for the rest of the stream."""
    spark, over = space.sparkSession, max(0, total - filled)
    whole, tail = divmod(over, size)
    extra = spark.range(whole).select(
        (F.col("id") + first).alias("sequence_id"), F.lit(0).cast("long").alias("inside"),
        (F.col("id") * size + filled).alias("low"), ((F.col("id") + 1) * size + filled).alias("high"),
    )
    ends, low, number = [], filled + whole * size, first + whole
    for bit in reversed(range(size.bit_length())):
        if tail >> bit & 1:
            ends.append((number, 0, low, low + (1 << bit)))
            low, number = low + (1 << bit), number + 1
    space = space.unionByName(extra)
    return space.unionByName(arrow_frame(spark, ["sequence_id", "inside", "low", "high"], ends)) if ends else space


def arrow_frame(spark: SparkSession, names: list[str], rows: list[tuple[int, ...]]) -> DataFrame:
    """A few rows of whole numbers as a frame; as Arrow, they need no Python workers besides those of the texts."""
    columns = [pa.array(column, pa.int64()) for column in zip(*rows, strict=True)]
    return spark.createDataFrame(pa.table(columns, names=names))


def filling(stream: DataFrame, space: DataFrame, total: int) -> DataFrame:
    """Cut the stream at the borders of the space; both are laid out on the same axis.

    Borders are grouped by blocks of the axis; each row of a block lasts until the next border.
    """
    document = F.struct("doc_id", "k1", "k2", "n", "rest", "crc", F.col("at").alias("low"))
    hole = F.struct("sequence_id", "inside", "low")

    def borders(rows: DataFrame, low: Column, high: Column, **known: Column) -> DataFrame:
        blocks = F.explode(F.sequence(F.floor(low / BLOCK), F.floor((high - 1) / BLOCK))).alias("block")
        rows = rows.select(blocks, low.alias("border"), *[c.alias(n) for n, c in known.items()])
        return rows.withColumn("border", F.greatest("border", F.col("block") * BLOCK))

    both = borders(stream, F.col("at"), F.col("at") + F.col("rest"), document=document).unionByName(
        borders(space, F.col("low"), F.col("high"), hole=hole), allowMissingColumns=True
    )
    along = Window.partitionBy("block").orderBy("border")
    until = along.rowsBetween(Window.unboundedPreceding, 0)
    both = both.select(
        "border",
        F.least(F.coalesce(F.lead("border").over(along), (F.col("block") + 1) * BLOCK), F.lit(total)).alias("next"),
        F.last("document", ignorenulls=True).over(until).alias("d"),
        F.last("hole", ignorenulls=True).over(until).alias("h"),
    ).where("next > border AND d IS NOT NULL AND h IS NOT NULL")
    return both.select(
        "d.doc_id", "d.k1", "d.k2", "d.rest", "d.crc",
        (F.col("d.n") - F.col("d.rest") + F.col("border") - F.col("d.low")).alias("start"),
        (F.col("next") - F.col("border")).alias("length"),
        F.col("d.n").alias("doc_tokens"), F.col("h.sequence_id").alias("sequence_id"),
        (F.col("h.inside") + F.col("border") - F.col("h.low")).alias("offset"),
    )
