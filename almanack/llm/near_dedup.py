"""Near-duplicate documents: banded min-hashes, sequential Bayesian verification, exact check.

1. Texts with equal shingle sets form a class; its smallest ``doc_id`` stands for it.
2. Bands of a class's signature are bucket keys; the bands are as many as miss a pair at the
   threshold with at most the chosen probability. In each bucket, members are paired with one
   centre, the member with most copies. The pairs also give clusters that hold every banded pair.
3. Pairs are verified in blocks: signatures are compared batch by batch, a pair is given up once the
   posterior probability that its similarity reaches the threshold is below ``miss``, and
   survivors are checked on their whole sets.
4. In clusters that these links leave in several components, members outside the largest one meet
   all members, again in blocks, and every pair of different components that shares a band is
   verified in the same way. So a link is found even if neither end resembles a centre, and no
   group of any size meets in one task or leaves all its pairs.
5. Components of all links come from alternating small and large stars of edges.

A-Z are compared in lower case; words are split at space and \\t to \\r. A text with fewer words than a
shingle has one shingle of them all. A text without words (NULL, empty) has an empty set and is
linked with nothing. Rows of one ``doc_id`` are one document. Rows without ``doc_id`` are not compared:
their component is NULL and they are kept. An empty table gives no rows; other columns are ignored.
Texts of any length are compared whole: a text's set is held by one task, 8 bytes a shingle.
Intermediate tables go once what is made of them is written.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, comb, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import batches_of_text, discard, mix64, staged, tidy
from almanack.llm.shingles import shingle_hashes, signatures

#: Min-hashes of a band, of a batch in verification, and in all for verification beyond the bands.
ROWS, BATCH, EXTRA = 4, 32, 64
#: Rows of either side of a block.
BLOCK = 800
#: Bytes of text that are signed at a time; a worker's arrays take some 25 times as much.
SIGN_BYTES = 1 << 20


def bands_for(threshold: float, miss: float) -> int:
    """So many bands that a pair at the threshold shares none with probability ``miss`` at most."""
    return ceil(log(miss) / log(1 - threshold**ROWS))


def least_matches(threshold: float, miss: float, size: int) -> list[int]:
    """After each batch, the matches below which a pair is given up.

    With a uniform prior, similarity after m matches of n is Beta(m + 1, n - m + 1); it reaches t
    with the probability that n + 1 draws of chance t succeed at most m times.
    """
    out = []
    for n in range(BATCH, size + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


# ---------------------------------------------------------------- signatures and sets


def signed(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """doc_id, n, s1, s2 (hash of the set), bands (bucket keys), sig (the other min-hashes)."""
    size = bands * ROWS + EXTRA

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_text(batches, limit=SIGN_BYTES):
            hashes, bounds = shingle_hashes(texts, words)
            sig = signatures(hashes, bounds, size)
            sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            with np.errstate(over="ignore"):
                s1 = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                s2 = np.array([mix64(s ^ np.uint64(0x5BF0)).sum(dtype=np.uint64) for s in sets], np.uint64)
                keys = sig[:, : bands * ROWS].reshape(len(sig), bands, ROWS).astype(np.uint64)
                mixed = np.zeros((len(sig), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                for j in range(ROWS):
                    mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + keys[:, :, j])
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sig) + 1, dtype=np.int32) * bands), pa.array(mixed.ravel().view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1.view(np.int64)),
                    pa.array(s2.view(np.int64)), lists, pa.array([row[bands * ROWS :].tobytes() for row in sig], pa.binary()),
                ],
                ["doc_id", "n", "s1", "s2", "bands", "sig"],
            )

    schema = "doc_id long, n long, s1 long, s2 long, bands array<long>, sig binary"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def with_sets(texts: DataFrame, words: int) -> DataFrame:
    """id, shingles (sorted 64-bit hashes as bytes) of the given rows of id and text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in batches_of_text(batches, limit=SIGN_BYTES):
            hashes, bounds = shingle_hashes(found, words)
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    return texts.mapInArrow(tidy(run), "id long, shingles binary")


# ---------------------------------------------------------------- verification in blocks


def links_of_block(frame: pd.DataFrame, num: int, den: int, least: list[int]) -> pd.DataFrame:
    """Links between the rows of side 0 and those of side 1, at most one per row and component."""
    left, right = frame[frame.side == 0], frame[frame.side == 1]
    links: list[tuple[int, int]] = []
    if len(left) and len(right):
        fresh = [np.frombuffer(b"".join(f.sig), np.uint32).reshape(len(f), -1) for f in (left, right)]
        ids, comps = (left.id.to_numpy(), right.id.to_numpy()), (left.comp.to_numpy(), right.comp.to_numpy())
        sets = [[np.frombuffer(s, np.uint64) for s in f.shingles] for f in (left, right)]
        shared = np.zeros((len(left), len(right)), bool)
        keys = [np.stack(f.bands.to_numpy()) for f in (left, right)]
        for one, other in zip(keys[0].T, keys[1].T, strict=True):
            shared |= one[:, None] == other[None, :]
        shared &= (ids[0][:, None] != ids[1][None, :]) & (comps[0][:, None] != comps[1][None, :])
        for row in np.flatnonzero(shared.any(axis=1)):
            open_ = np.flatnonzero(shared[row])
            matches = np.zeros(len(open_), np.int64)
            for turn, fewest in enumerate(least):
                at = slice(turn * BATCH, (turn + 1) * BATCH)
                matches += (fresh[1][open_, at] == fresh[0][row, at]).sum(axis=1)
                stay = matches >= fewest
                open_, matches = open_[stay], matches[stay]
            open_ = open_[np.argsort(-matches, kind="stable")]
            own = sets[0][row]
            while len(open_):
                other, open_ = open_[0], open_[1:]
                both = sets[1][other]
                common = int(np.isin(both, own, assume_unique=True).sum()) if len(own) else 0
                if den * common >= num * (len(own) + len(both) - common):
                    links.append((ids[0][row], ids[1][other]))
                    open_ = open_[comps[1][open_] != comps[1][other]]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def verified(pairs: DataFrame, rows: DataFrame, num: int, den: int, least: list[int]) -> DataFrame:
    """Links from ``pairs`` (g1, g2, g3: a block; side, id, comp) with the signatures and sets of ``rows``."""
    full = pairs.join(rows, "id").select("g1", "g2", "g3", "side", "id", "comp", "bands", "sig", "shingles")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return links_of_block(frame, num, den, least)

    return full.groupBy("g1", "g2", "g3").applyInPandas(run, "a long, b long")


# ---------------------------------------------------------------- components


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, comp (the smallest node reachable) of all nodes of the edges (a, b).

    Alternates large and small stars until the edges stay the same; hubs only give their minimum.
    Fails if they still change after ``most`` rounds.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges, before = staged(edges, "edges"), None
    for _ in range(most):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        both_ends = F.array(*[F.struct(F.col(end).alias("u"), F.col("m").alias("v")) for end in ("v", "u")])
        small = large.join(least, "u").select(F.inline(both_ends))
        older, edges = edges, staged(small.where("u > v").distinct(), "edges")
        discard(older)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {most} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.union(edges.select("v", "v").distinct())


# ---------------------------------------------------------------- the operator


def near_duplicates(
    docs: DataFrame, *, words: int = 5, num: int = 4, den: int = 5, band_miss: float = 1e-5, miss: float = 1e-6
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: texts with similarity >= num / den are linked."""
    threshold = num / den
    bands, least = bands_for(threshold, band_miss), least_matches(threshold, miss, EXTRA)
    rows = staged(signed(docs, words, bands), "signatures")
    real = rows.where("doc_id IS NOT NULL AND n > 0")
    best = F.min_by(F.struct("bands", "sig"), "doc_id").alias("best")
    classes = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), best)
    classes = staged(classes.select("s1", "s2", "id", "copies", "best.bands", "best.sig"), "classes")
    signed_rows, rows = rows, staged(rows.select("doc_id", "n", "s1", "s2"), "rows")
    discard(signed_rows)

    keys = classes.select("id", "copies", F.explode("bands").alias("key"))
    centre = F.max(F.struct("copies", (-F.col("id")).alias("id"))).alias("top")
    buckets = keys.groupBy("key").agg(F.count("*").alias("members"), centre).where("members > 1")
    edges = keys.join(buckets, "key").select("id", (-F.col("top.id")).alias("centre")).where("id <> centre").distinct()
    edges = staged(edges, "candidates")

    stars = components(edges.select(F.col("id").alias("a"), F.col("centre").alias("b")))
    clusters = staged(stars, "clusters")
    members = clusters.select(F.col("node").alias("id"))
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(members, "id")
    members = classes.select("id", "bands", "sig").join(with_sets(texts, words).dropDuplicates(["id", "shingles"]), "id")
    members = staged(members, "members")
    signed_classes, classes = classes, staged(classes.select("s1", "s2", "id"), "classes")
    discard(signed_classes)

    # Members against the centres of their buckets.
    stars = edges.join(edges.groupBy("centre").count(), "centre")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / BLOCK)).alias("g2")
    stars = stars.select(F.col("centre").alias("g1"), part, F.lit(0).cast("long").alias("g3"), "id")
    far = stars.select("*", F.lit(1).alias("side"), F.col("id").alias("comp"))
    near = stars.select("g1", "g2", "g3", F.col("g1").alias("id"), F.lit(0).alias("side"), F.col("g1").alias("comp")).distinct()
    links = staged(verified(near.unionByName(far), members, num, den, least), "links")

    # Members outside the largest component of their cluster against all of it.
    found = components(links)
    state = clusters.join(found, "node", "left").select("node", clusters["comp"].alias("cluster"), F.coalesce(found["comp"], "node").alias("comp"))
    state = staged(state, "state")
    sizes = state.groupBy("cluster", "comp").agg(F.count("*").alias("size"))
    total = sizes.groupBy("cluster").agg(
        F.count("*").alias("parts"), F.sum("size").alias("all"), F.max(F.struct("size", "comp")).alias("top")
    ).where("parts > 1")
    total = total.select("cluster", "all", F.col("top.comp").alias("main"), (F.col("all") - F.col("top.size")).alias("rest"))
    state = state.join(total, "cluster").withColumn("at", F.xxhash64("node"))
    xs, ys = F.ceil(F.col("rest") / BLOCK), F.ceil(F.col("all") / BLOCK)
    names = [F.col("cluster").alias("g1"), "g2", "g3", F.col("node").alias("id"), "comp"]
    outside = state.where("comp <> main").withColumns({"g2": F.pmod("at", xs), "g3": F.explode(F.sequence(F.lit(0).cast("long"), ys - 1))})
    inside = state.withColumns({"g3": F.pmod("at", ys), "g2": F.explode(F.sequence(F.lit(0).cast("long"), xs - 1))})
    blocks = outside.select(*names, F.lit(0).alias("side")).unionByName(inside.select(*names, F.lit(1).alias("side")))
    more = staged(verified(blocks, members, num, den, least), "links")
    discard(members)

    final = components(links.unionByName(more))
    named = classes.join(final, classes["id"] == final["node"], "left")
    named = named.select("s1", "s2", F.coalesce("comp", "id").alias("component_id"))
    out = rows.join(named, ["s1", "s2"], "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    )
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
