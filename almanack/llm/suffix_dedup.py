"""Removal of repeated strings with suffix arrays.

Every byte covered by a ``length``-byte string that starts at two places or more, in one text or in
several, is removed. The steps:

1. Each ``length``-byte string has one anchor: the place of the smallest hash of its ``gram``-byte
   parts, a function of its bytes alone. Strings with one anchor follow each other; together they
   are a segment. An anchor hash that occurs once in all texts can't belong to a repeated string,
   so only segments of repeated anchors go on. Equal segments go on once, with their number.
2. Segments are dealt to shards by anchor hash. An anchor with many different segments is dealt to
   several shards. Each shard sorts its suffixes with a suffix array built by Larsson-Sadakane
   refinement: groups of equal suffixes are sorted by the rank of the suffix one group depth on,
   and the depth doubles up to ``length``.
3. Common prefixes of neighbours follow Kasai's rule (a suffix shares at least one byte less than the
   suffix before it in the text), so only places where the rule says nothing are compared.
   Neighbours that share ``length`` bytes are repeats.
4. Strings of anchors that are in several shards are merged across shards: each shard gives its
   sorted distinct strings as 128-bit fingerprints, ranges of fingerprints meet, and each sorted
   run looks its entries up in the others by binary search.
5. The repeated strings of each segment become byte ranges of each of its documents.

NULL and empty texts have nothing to remove. Rows without ``doc_id`` take part like others. Rows of
one ``doc_id`` with different texts are different texts (told apart by 15 bits of a hash); equal rows
repeat each other. An empty table gives no rows. Other columns are ignored. Matches never cross
texts. A text of any length is held by one task; a long one is a slice of its own.

Keys that hold many rows (an anchor or segment of a third of all texts) are joined in parts: the few
such keys are broadcast, their rows are dealt by a hash of their place, and their one row on the
other side is repeated per part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import batches_of_text, grams_hash, spans_hash, staged, text_bytes

#: Different segments of one anchor in a shard, and segments that a shard is meant to hold: its arrays fit a processor's cache.
SPLIT, SHARD = 2_000, 1_000
#: Bytes of text whose hashes are worked out at a time, so that these fit the cache as well.
HASHED = 256 << 10
#: A key with more rows than both ``PART`` and a ``KEYS``-th of them all is joined in parts, so such keys are fewer than ``KEYS``.
PART, KEYS = 10_000, 100_000
#: Most strings of a segment: their number takes 12 bits of a place.
STRINGS = (1 << 12) - 1


# ---------------------------------------------------------------- anchors and segments


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """start (in ``data``), strings, anchor hash: the runs of strings that share an anchor."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64))
    grams = grams_hash(data, gram, seed=3)
    # The low bits tell places apart, so that the leftmost of equal parts is a window's anchor.
    low = np.uint64((1 << 24) - 1)
    least = sliding_least((grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low), length - gram + 1)
    sizes = np.diff(offsets)
    strings = np.maximum(sizes - length + 1, 0)
    inside = np.zeros(len(data) + 1, np.int8)
    some = strings > 0
    np.add.at(inside, offsets[:-1][some], 1)
    np.add.at(inside, offsets[:-1][some] + strings[some], -1)
    inside = np.cumsum(inside[: len(least)], dtype=np.int8) > 0
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    new[offsets[:-1][some]] = True
    starts = np.flatnonzero(new)
    stop = inside.copy()
    stop[:-1] &= new[1:] | ~inside[1:]
    runs = np.flatnonzero(stop) + 1 - starts
    anchors = starts + ((least[starts].astype(np.int64) - starts) & ((1 << 24) - 1))
    return starts, runs, grams[anchors]


def segments_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """text, start, strings, anchor hash, segment hash: the runs of strings that share an anchor.

    A segment of s strings is length + s - 1 bytes long and begins at ``start`` of its text. All of its
    strings hold the one anchor, so they overlap, and no two of them are equal.
    """
    starts, runs, m = anchored_runs(data, offsets, length, gram)
    hashes = spans_hash(data, starts, starts + runs - 1 + length, seed=5)
    text = np.searchsorted(offsets, starts, side="right") - 1
    return text, starts - offsets[text], runs, m, hashes


def anchor_hashes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """m of each segment, without the rest of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batches_of_text(batches, limit=HASHED):
            _, _, m = anchored_runs(*text_bytes(texts), length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64))], ["m"])

    return docs.select("text").mapInArrow(run, "m long")


def segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """m (anchor hash), s (segment hash), d (row), place (tag of the text, start and strings in one number)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_text(batches, limit=HASHED):
            text, start, runs, m, s = segments_of(*text_bytes(texts), length, gram)
            rows = batch.select(["d", "tag"]).take(pa.array(text))
            place = (np.asarray(rows.column("tag")) << 48) | (start << 12) | runs
            columns = [pa.array(m.view(np.int64)), pa.array(s.view(np.int64)), rows.column("d"), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, ["m", "s", "d", "place"])

    return docs.select("d", "tag", "text").mapInArrow(run, "m long, s long, d long, place long")


# ---------------------------------------------------------------- suffix arrays


def in_order(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``keys`` (below ``2**bits``) in ascending order, equal ones as they come, and the sorted keys.

    Key and place are sorted as one number, which is several times faster than sorting places by keys.
    """
    low = len(keys).bit_length()
    if bits + low > 64:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    both = np.sort((keys << np.uint64(low)) | np.arange(len(keys), dtype=np.uint64))
    return (both & np.uint64((1 << low) - 1)).astype(np.int64), both >> np.uint64(low)


def suffix_ranks(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in order of their first ``depth`` bytes, and each place's rank (equal if these are).

    Larsson-Sadakane refinement: the rank of a place is the end of its group; places in groups of
    their own are done, and only larger groups are sorted again, by the ranks ``have`` bytes on.
    ``data`` has to go on for ``depth`` bytes after its last place.
    """
    n, m = len(data) - depth, len(data) - 7
    bits = m.bit_length()
    have = max(1, (64 - bits) // 8)
    first = np.zeros(m, np.uint64)
    for k in range(have):
        first = (first << np.uint64(8)) | data[k : k + m]
    order, keys = in_order(first, 8 * have)
    ranks = np.empty(m, np.int64)
    at, places = np.arange(m), order  # what is to be ranked: where in the order, and which place
    while True:
        heads = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))  # last place of each group
        sizes = np.diff(heads, prepend=-1)
        ranks[places] = np.repeat(at[heads], sizes)
        # Places of groups with more than one member, group by group.
        many = np.repeat(sizes > 1, sizes)
        at, places, sizes = at[many], places[many], sizes[sizes > 1]
        if have >= depth or not len(at):
            return order[order < n], ranks
        step = min(have, depth - have)
        beyond = places + step
        following = np.where(beyond < m, ranks[np.minimum(beyond, m - 1)] + 1, 0).astype(np.uint64)
        group = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
        turn, keys = in_order((group << np.uint64(bits)) | following, bits + len(sizes).bit_length())
        places = places[turn]
        order[at] = places
        have += step


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place the bytes it shares with its predecessor in ``order``, at most ``most``.

    Kasai's rule in bulk: where the bytes before a place and before its predecessor are equal and
    the place before has the place before as its own predecessor, one byte less is shared than there;
    only the other places are compared, eight bytes at a time.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (before[:-1] >= 0) & (before[1:] == before[:-1] + 1)
    follows[1:] &= data[: n - 1] == data[np.maximum(before[1:] - 1, 0)]
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel()
    shared, todo = np.zeros(n, np.int64), np.flatnonzero(~follows & (before >= 0))
    shared[todo] = _compared(words, todo, before[todo], 2 * most)
    # Along a chain of followers the shared bytes shrink by one at each place.
    place = np.arange(n)
    source = np.maximum.accumulate(np.where(follows, -1, place))
    out = np.where(follows, shared[source] - (place - source), shared)
    # The head of a chain was only compared up to a limit; where that tells too little, compare anew.
    doubtful = np.flatnonzero(follows & (shared[source] >= 2 * most) & (out < most))
    out[doubtful] = _compared(words, doubtful, before[doubtful], most)
    return np.minimum(out, most)


def _compared(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    shared, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for reach in range(0, most + 8, 8):
        inside = (a[live] + reach < len(words)) & (b[live] + reach < len(words))
        live = live[inside]
        differ = words[a[live] + reach] ^ words[b[live] + reach]
        same = differ == 0
        low = differ[~same] & (~differ[~same] + np.uint64(1))
        shared[live[~same]] = reach + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        live = live[same]
        shared[live] = reach + 8
    return shared


def repeats_of_shard(texts: list[bytes], weights: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Per string of the shard's segments: segment, place in it, group (equal strings), weight of the group."""
    sizes = [len(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(length + 16), np.uint8)
    order, _ = suffix_ranks(data[: offsets[-1] + length], length)
    segment = np.repeat(np.arange(len(texts)), sizes)[order]
    shared = common_prefixes(data, order, length)[order]
    whole = order + length <= offsets[segment + 1]
    # Places too near a segment's end hold no string of it; neighbours across them share the least on the way.
    order, segment = order[whole], segment[whole]
    cuts = np.flatnonzero(whole)
    if not len(cuts):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    least = np.minimum.reduceat(shared[: cuts[-1] + 1], np.concatenate([[0], cuts[:-1] + 1]))
    new = least < length
    new[0] = True
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=weights[segment]).astype(np.int64)
    return segment, order - offsets[segment], group, total[group]


# ---------------------------------------------------------------- the operator


def row_key(docs: DataFrame) -> DataFrame:
    """doc_id, text, d and tag: a row's key is its id (or a hash of its text) and 15 bits of its text's hash."""
    text = F.xxhash64(F.lit(7), "text")
    return docs.select("doc_id", "text", F.coalesce("doc_id", text).alias("d"), F.pmod(text, F.lit(1 << 15)).alias("tag"))


def cut_segments(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The bytes of the chosen segments, found in the texts of their rows."""
    lists = chosen.groupBy("d", "tag").agg(F.collect_list(F.struct("m", "s", "place", "copies", "parts")).alias("found"))
    texts = docs.join(lists, ["d", "tag"]).select("text", "found")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["m", "s", "copies", "parts"]
        for batch, texts in batches_of_text(batches):
            data, offsets = text_bytes(texts)
            raw, found = data.tobytes(), batch.column("found")
            bounds = np.asarray(found.offsets, dtype=np.int64)
            items = found.flatten()
            place = np.asarray(items.field("place"))
            start = np.repeat(offsets[:-1], np.diff(bounds)) + ((place >> 12) & ((1 << 36) - 1))
            stop = start + length - 1 + (place & 4095)
            pieces = [raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(items.field(n) for n in names), pa.array(pieces, pa.binary())], [*names, "bytes"])

    return texts.mapInArrow(run, "m long, s long, copies long, parts long, bytes binary")


def shard_repeats(shards: DataFrame, length: int) -> DataFrame:
    """Of each shard: m, s, low, high of repeated strings; and strings of split anchors to merge (merge = 1)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        texts, m, s = frame["bytes"].tolist(), frame["m"].to_numpy(), frame["s"].to_numpy()
        segment, place, group, weight = repeats_of_shard(texts, frame["copies"].to_numpy(), length)
        sure = pd.DataFrame({"segment": segment, "place": place})[weight > 1].groupby("segment")["place"].agg(["min", "max"])
        own = sure.index.to_numpy()
        ranges = pd.DataFrame({"m": m[own], "s": s[own], "low": sure["min"].to_numpy(), "high": sure["max"].to_numpy(), "merge": 0, "f1": 0, "f2": 0, "weight": 2})
        split = frame["parts"].to_numpy()[segment] > 1
        # Of strings repeated here one entry is enough for the other shards.
        take = split & ((weight == 1) | np.concatenate([[True], group[1:] != group[:-1]])[: len(group)])
        segment, place, weight = segment[take], place[take], weight[take]
        prints = b"".join(hashlib.blake2b(texts[i][p : p + length], digest_size=16).digest() for i, p in zip(segment.tolist(), place.tolist(), strict=True))
        prints = np.frombuffer(prints, np.int64).reshape(-1, 2)
        entries = pd.DataFrame({"m": m[segment], "s": s[segment], "low": place, "high": place, "merge": 1, "f1": prints[:, 0], "f2": prints[:, 1], "weight": weight})
        return pd.concat([ranges, entries]).assign(shard=frame["shard"].iloc[0])

    schema = "m long, s long, low long, high long, merge long, f1 long, f2 long, weight long, shard long"
    return shards.groupBy("shard").applyInPandas(run, schema)


def merged(entries: DataFrame, ranges: int) -> DataFrame:
    """m, s, low, high of split anchors' strings that another shard has as well.

    Each shard's entries of a fingerprint range form a sorted run; runs are merged one after the other,
    and each is looked up in what the earlier ones hold by binary search. A run holds an entry per
    distinct string, so a string has at most one entry per shard.
    """
    entries = entries.withColumn("range", F.pmod("f1", F.lit(ranges)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["f1", "f2"])
        kind = [("f1", "i8"), ("f2", "i8")]
        held, again = np.zeros(0, kind), [np.zeros(0, kind)]
        for _, part in frame.groupby("shard"):
            own = np.zeros(len(part), kind)
            own["f1"], own["f2"] = part["f1"].to_numpy(), part["f2"].to_numpy()
            place = np.searchsorted(held, own)
            seen = np.zeros(len(own), bool)
            inside = place < len(held)
            seen[inside] = held[place[inside]] == own[inside]
            again.append(own[seen])
            held = np.insert(held, place[~seen], own[~seen])
        found = np.unique(np.concatenate(again))
        return pd.DataFrame({"f1": found["f1"], "f2": found["f2"]})

    repeated = entries.select("range", "shard", "f1", "f2").groupBy("range").applyInPandas(run, "f1 long, f2 long")
    return entries.where("weight = 1").join(repeated, ["f1", "f2"]).select("m", "s", "low", "high")


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans for each row, given spans (d, tag, spans)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_text(batches):
            data, offsets = text_bytes(texts)
            raw, kept, counts, cut = data.tobytes(), [], [], []
            for row, found in enumerate(batch.column("spans").to_pylist()):
                first, last = int(offsets[row]), int(offsets[row + 1])
                pieces, at, runs, gone = [], first, 0, 0
                for x in found or ():  # in order of their beginnings
                    low, high = first + x["low"], first + x["high"]
                    if low > at or runs == 0:
                        pieces.append(raw[at:low])
                        runs += 1
                        at = low
                    gone += max(0, high - at)
                    at = max(at, high)
                kept.append(b"".join(pieces) + raw[at:last])
                counts.append(runs)
                cut.append(gone)
            numbers = (pa.array(x, pa.int64()) for x in (np.diff(offsets), cut, counts))
            columns = [batch.column("doc_id"), pa.array(kept, pa.binary()), *numbers]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    rows = docs.join(spans, ["d", "tag"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def hot_keys(counts: DataFrame, on: list[str], times: str) -> DataFrame:
    """The keys of ``counts`` (one row per key) with too many rows for one task, and in how many ``parts`` they go."""
    total = counts.agg(F.sum(times)).first()[0] or 0
    most = max(PART, total // KEYS)
    return counts.where(F.col(times) > most).select(*on, F.ceil(F.col(times) / most).alias("n_parts"))


def spread_join(rows: DataFrame, keys: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` (with d, place) joined to ``keys`` (one row per key); the rows of hot keys meet in several tasks."""
    hot = F.broadcast(hot)  # fewer than KEYS rows
    parts = F.coalesce("n_parts", F.lit(1))
    rows = rows.join(hot, on, "left").withColumn("part", F.pmod(F.xxhash64("d", "place"), parts)).drop("n_parts")
    keys = keys.join(hot, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n_parts")
    return rows.join(keys, [*on, "part"]).drop("part")


def remove_repeats(docs: DataFrame, *, length: int = 200, gram: int = 64) -> DataFrame:
    """doc_id, kept, n_bytes, n_removed, n_spans of every row of ``docs`` (doc_id, text).

    ``gram`` is at most ``length``, and less than 4096 bytes shorter.
    """
    if not 0 < gram <= length <= gram + STRINGS - 1:
        raise ValueError(f"gram has to be at most length and at most {STRINGS - 1} bytes shorter")
    docs = row_key(docs)
    every = segments(docs, length, gram)
    anchors = staged(anchor_hashes(docs, length, gram).groupBy("m").agg(F.count("*").alias("times")).where("times > 1"), "anchors")
    found = staged(spread_join(every, anchors.select("m"), hot_keys(anchors, ["m"], "times"), ["m"]), "segments")

    # Equal segments once, from one of their rows; anchors with many of them over several shards.
    one = F.min(F.struct("d", "place")).alias("one")
    unique = found.groupBy("m", "s").agg(F.count("*").alias("copies"), one).select("m", "s", "copies", "one.*")
    unique = staged(unique.withColumn("tag", F.shiftright("place", 48)), "unique-segments")
    parts = unique.groupBy("m").agg(F.count("*").alias("different"))
    many = hot_keys(parts, ["m"], "different")
    parts = parts.select("m", F.ceil(F.col("different") / SPLIT).alias("parts"))
    shards = max(1, -(-unique.count() // SHARD))
    # Equal rows would give a segment's bytes twice.
    pieces = cut_segments(docs.dropDuplicates(["d", "tag"]), spread_join(unique, parts, many, ["m"]), length)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("m", F.pmod("s", F.col("parts"))), F.lit(shards)))
    entries = staged(shard_repeats(pieces, length), "shard-repeats")
    merge = merged(entries.where("merge = 1"), shards)
    places = entries.where("merge = 0").select("m", "s", "low", "high").unionByName(merge)

    # A segment's repeated strings overlap or touch, so they are one range of it.
    marks = places.groupBy("m", "s").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    start = F.shiftright("place", 12).bitwiseAND((1 << 36) - 1)
    spans = spread_join(found, marks, hot_keys(unique, ["m", "s"], "copies"), ["m", "s"]).select(
        "d", F.shiftright("place", 48).alias("tag"), (start + F.col("low")).alias("low"), (start + F.col("high") + length).alias("high")
    )
    spans = spans.groupBy("d", "tag").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("spans"))
    return removed(docs, staged(spans, "spans"))
