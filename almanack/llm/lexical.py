"""Ranked lexical search, reversed: the items' terms are the index, and the documents stream through it.

An inverted index of the items (term, the items that hold it, how often) goes to every task. One pass over the
documents counts how often each document holds each indexed term; the counts are a table. From it come the
number of documents, of all terms and of documents per term, and with them the weights. A second pass streams
the counts through the index: a document's gain for a term is added to every item that holds the term, and each
task keeps one heap of the ``k`` best documents per item. The heaps are merged per item.

The index is bounded: items whose texts together exceed ``BLOCK_BYTES`` are taken in blocks, each with its own
pass. A heap holds ``k`` rows whatever a task reads, so no document, term or item makes a task or a group grow.

Terms are runs of ASCII letters and digits and of all characters from U+0080 on, A-Z in lower case. They are
told apart by hashes of 128 bits. A NULL or empty text has no terms; such a document counts nowhere, such an item has
no results, and neither has an item whose terms no document holds. Rows without ``doc_id`` or ``item_id`` take no
part. Every row is a document of its own, so a repeated row ranks twice; a repeated ``item_id`` counts once, with its
smallest text. Equal scores go by the smaller ``doc_id``. Very long texts are hashed piece by piece. Columns
other than the ids and the texts are not looked at. An empty table on either side gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from almanack.llm.common import SLICE_BYTES, batches_of_text, slices, spans_hash, staged, text_bytes

#: Bytes of item texts that are indexed and handed to the tasks at once.
BLOCK_BYTES = 8 << 20
#: Sums that a task adds up at a time.
SUMS = 1 << 21

_TERM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _TERM[_low:_high] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-case bytes of all texts, and the start, the stop and the text of each term."""
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    inside = _TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < len(data)]  # terms end where their text does
    first[heads] = inside[heads]
    last[heads[heads > 0] - 1] = inside[heads[heads > 0] - 1]
    starts = np.flatnonzero(first)
    return data, starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Two hashes per term, worked out over some MB of text at a time."""
    out = np.empty((2, len(starts)), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(stops, starts[at] + SLICE_BYTES, side="right")))
        low, high = int(starts[at]), int(stops[end - 1])
        for seed in (1, 2):
            out[seed - 1, at:end] = spans_hash(data[low:high], starts[at:end] - low, stops[at:end] - low, seed)
        at = end
    return out


@dataclass
class Index:
    """Terms in ascending order of their first hash, and for each the items that hold it."""

    items: list[int]
    h1: np.ndarray
    h2: np.ndarray
    first: np.ndarray  # where each term's items begin in ``item``
    item: np.ndarray  # positions in ``items``
    repeats: np.ndarray
    longest: int  # terms with repeats of the longest item

    @classmethod
    def of(cls, items: list[int], texts: list[str]) -> Index:
        data, starts, stops, row = terms_of(pa.array(texts, pa.string()))
        h1, h2 = hashes(data, starts, stops)
        order = np.lexsort((row, h2, h1))
        h1, h2, row = h1[order], h2[order], row[order]
        new_term = np.ones(len(h1), bool)
        new_term[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_pair = new_term.copy()
        new_pair[1:] |= row[1:] != row[:-1]
        pairs = np.flatnonzero(new_pair)
        first = np.searchsorted(pairs, np.append(np.flatnonzero(new_term), len(h1)))
        longest = int(np.bincount(row).max()) if len(row) else 0
        return cls(items, h1[new_term], h2[new_term], first, row[pairs], np.diff(np.append(pairs, len(h1))), longest)

    def __len__(self) -> int:
        return len(self.h1)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each term, or -1; terms with one first hash lie side by side."""
        found = np.full(len(h1), -1, np.int64)
        at = np.searchsorted(self.h1, h1)
        while True:
            same = at < len(self)
            same[same] = self.h1[at[same]] == h1[same]
            if not same.any():
                return found
            right = np.flatnonzero(same)
            right = right[self.h2[at[right]] == h2[right]]
            found[right] = at[right]
            at = np.where(same & (found < 0), at + 1, len(self))


def counted(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, n, terms, tfs: all terms of each document, its indexed terms and how often it holds them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_text(batches):
            data, starts, stops, row = terms_of(texts)
            n = np.bincount(row, minlength=len(texts))
            term = index.find(*hashes(data, starts, stops))
            known = term >= 0
            pair, tf = np.unique(row[known] * len(index) + term[known], return_counts=True)
            doc, term = np.divmod(pair, max(1, len(index)))
            offsets = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (term.astype(np.int32), tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0")


def ranges(first: np.ndarray, width: np.ndarray) -> np.ndarray:
    """All places first[i] .. first[i] + width[i] - 1, one range after the other."""
    return np.repeat(first - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))


def divided(factor: int, counts: np.ndarray, by: int) -> np.ndarray:
    """factor * counts div by, exactly, also where the product needs more than 64 bits."""
    if len(counts) and factor * int(counts.max()) >= 1 << 63:
        return np.array([factor * int(c) // by for c in counts], np.int64)
    return counts * factor // by


def summed(place: np.ndarray, gain: np.ndarray, size: int, most: int) -> np.ndarray:
    """Whole-number sums per place; doubles hold them exactly while no sum can reach 2**53."""
    if not len(gain) or int(gain.max()) * most < 1 << 53:
        return np.bincount(place, weights=gain, minlength=size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, place, gain)
    return out


def heaped(counts: DataFrame, index: Index, weights: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the ``k`` best documents of each item among those that a task reads."""
    items, width = len(index.items), np.diff(index.first)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        bar = np.ones(items, np.int64)  # the least score that can enter an item's heap
        for batch in batches:
            ids, n = (np.asarray(batch.column(c)) for c in ("doc_id", "n"))
            lists = batch.column("terms")
            bounds, term = np.asarray(lists.offsets), np.asarray(lists.flatten(), np.int64)
            tf, bounds = np.asarray(batch.column("tfs").flatten()), bounds - bounds[0]
            m = 75 + divided(25 * documents, n, terms)
            upto = np.append(0, np.cumsum(width[term]))[bounds]
            for a, b in slices(np.maximum(np.diff(upto), items), SUMS):
                part = slice(bounds[a], bounds[b])
                t, f = term[part], tf[part]
                doc = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
                gain = weights[t] * (1_000_000_000 * f // (1000 * f + 12 * m[a:b][doc]))
                at, wide = ranges(index.first[t], width[t]), width[t]
                place = np.repeat(doc, wide) * items + index.item[at]
                gain = np.repeat(gain, wide) * index.repeats[at]
                scores = summed(place, gain, (b - a) * items, index.longest).reshape(b - a, items)
                least = np.partition(scores, b - a - k, axis=0)[b - a - k] if b - a > k else 1
                rows, columns = np.nonzero(scores >= np.maximum(bar, least))
                for row, item, score in zip(rows.tolist(), columns.tolist(), scores[rows, columns].tolist(), strict=True):
                    heap, entry = heaps[item], (score, -int(ids[a + row]))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        bar[item] = heap[0][0]
        rows = [(index.items[i], -doc, score) for i, heap in enumerate(heaps) for score, doc in heap]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return counts.mapInArrow(run, "item_id long, doc_id long, score long")


def searched(docs: DataFrame, index: Index, k: int) -> DataFrame:
    counts = staged(counted(docs, index), "term-counts")
    documents, terms = counts.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(index), np.int64)
    # At most one row per term of the index, which is bounded.
    for term, holders in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = holders
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()]
    return heaped(counts, index, np.array(weights, np.int64), documents, terms or 1, k)


def search(docs: DataFrame, items: DataFrame, *, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of each item with the highest scores above 0.

    ``docs`` has doc_id and text, ``items`` has item_id and text.
    """
    asked = items.where("item_id IS NOT NULL").groupBy(F.col("item_id").cast("long").alias("item_id"))
    asked = asked.agg(F.min("text").alias("text")).where("text <> ''")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        part = searched(docs, Index.of([r["item_id"] for r in rows], [r["text"] for r in rows]), k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
