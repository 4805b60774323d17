"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Equal vectors are one node, so that a vector of any number of copies is indexed once. The first graph
links nodes that fall into one cell of random hyperplanes, in several tables; cells are split until
small. Each round of NN-descent then gathers, around every node, a sample of its neighbours in both
directions, compares them with each other where one of them is new, and keeps the nearest ``degree`` of
every node. An edge stays new until it was in a sample. Edges and samples are so many that the graph itself
holds most nearest nodes, also of vectors without structure: a search on a poorer graph takes ever wider
beams as the table grows. A search starts a query at its nearest landmarks
(a fixed number of nodes) and at its own node if it is indexed, and keeps expanding the nearest ``beam``
nodes found so far until all of them are expanded. How wide a beam must be depends on the vectors and
their number, so it is doubled until a twice as wide one changes next to no result. Results are ranked by
exact distances in double precision.

Nodes are numbered by their cells and stand in blocks of ``BLOCK``; queries stand in groups of about ``GROUP``.
A block or group is one row with its arrays, and what it has to tell another is one row (a packet) too, so that
Spark moves few rows and each step is array code on one block. A packet holds what it says only once however many
nodes of the block ask for it.

Vectors that are NULL, zero, of another length than most, or hold NULL or non-finite components take
no part, neither as queries nor as candidates; nor do rows without an id. Equal distances go by the
smaller id. A repeated id counts once, with its smallest vector hash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from almanack.llm.common import discard, mix64, slices, smallest, staged

#: Rows of a cell that are compared with each other.
CELL = 300
#: Nodes that every search may start from.
LANDMARKS = 256
#: Nodes of a block, and queries of a group (on average): what a task holds at a time.
BLOCK, GROUP = 2048, 32
#: Blocks that a search looks up together, at most.
SHARD = 16
#: Bytes of arrays that packets hold together, at most, before they go out.
MOST = 32 << 20
#: Nodes that are compared at a time, so that their arrays fit a cache.
AT_ONCE = 32

#: A row to or of a block: what it is, the block or group that it comes from, a count, and arrays as bytes.
PACKET = "block long, kind int, src long, n long, a binary, b binary, c binary, d binary, e binary"
SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("src", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in "abcde")])
VECTORS, STATE, OFFER, AROUND, REQUEST, ANSWER, FOUND, ADJACENT, EXPAND, COUNTED, RESTING = range(11)

#: Places in a block or group.
SLOT = np.uint16
#: The bits of a node's number in a key of (place, node).
BITS = 44


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of doubles."""
    if len(column) == 0:
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec of the vectors that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(good & F.exists("embedding", lambda x: x != 0)).select("vec_id", F.col("embedding").alias("vec"))
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    rows = rows.where(F.size("vec") == (sizes["dim"] if sizes else 0))
    # 0.0 and -0.0 are one value, so they must not make two vectors.
    return rows.withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0).cast("float")).otherwise(x.cast("float"))))


# ---------------------------------------------------------------- packets


def packet(block: int, kind: int, src: int, n: int, *arrays: np.ndarray) -> pa.Table:
    row = [[block], [kind], [src], [n], *([x.tobytes()] for x in arrays), *([None] for _ in range(5 - len(arrays)))]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(row, SCHEMA, strict=True)], schema=SCHEMA)


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of ``values[bounds[i]:bounds[i + 1]]``, a cell each."""
    values = np.ascontiguousarray(values)
    wide = values.itemsize * int(np.prod(values.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * wide).astype(np.int32)), pa.py_buffer(values)])


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)]), len(x)).astype(np.int64)


def places(x: np.ndarray) -> np.ndarray:
    """The place of each value in its run of equal values."""
    bounds = runs(x)
    return np.arange(len(x)) - np.repeat(bounds[:-1], np.diff(bounds))


def addressed(kind: int, src: int, to: np.ndarray, *arrays: np.ndarray) -> pa.Table:
    """A packet for each of the blocks ``to`` (in order), with its part of the arrays."""
    bounds = runs(to)
    count = len(bounds) - 1
    wide = max(x.itemsize * int(np.prod(x.shape[1:])) for x in arrays)
    if count > 1 and len(to) * wide > MOST:
        cut = bounds[count // 2]
        return pa.concat_tables([addressed(kind, src, to[:cut], *(x[:cut] for x in arrays)), addressed(kind, src, to[cut:], *(x[cut:] for x in arrays))])
    columns = [to[bounds[:-1]], np.full(count, kind), np.full(count, src), np.diff(bounds)]
    columns = [pa.array(x, f.type) for x, f in zip(columns, SCHEMA, strict=False)] + [binaries(x, bounds) for x in arrays]
    return pa.Table.from_arrays(columns + [pa.nulls(count, pa.binary())] * (len(SCHEMA) - len(columns)), schema=SCHEMA)


def of(table: pa.Table, *kinds: int) -> pa.Table:
    return table.filter(pc.is_in(table.column("kind"), pa.array(kinds, pa.int32()))).select(SCHEMA.names)


def whole(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    """The arrays of a column, one after the other."""
    parts = [np.zeros(0, np.uint8)]
    for chunk in table.column(name).chunks:
        _, bounds, data = chunk.buffers()
        if len(chunk) and data is not None:
            bounds = np.frombuffer(bounds, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]])
    return np.concatenate(parts).view(dtype)


def per_item(table: pa.Table, column: str = "src") -> np.ndarray:
    """A column of the packets, once for each of their items."""
    return np.repeat(table.column(column).to_numpy(), table.column("n").to_numpy())


def each(rows: list[DataFrame], parts: int, step: Callable[[int, pa.Table], Iterable[pa.Table]]) -> DataFrame:
    """The packets that ``step`` makes of those of each block."""
    rows_of_all = rows[0]
    for more in rows[1:]:
        rows_of_all = rows_of_all.unionByName(more)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packets in step(key[0].as_py(), pa.Table.from_batches(list(batches))):
            yield from packets.to_batches()

    return rows_of_all.repartition(parts, "block").groupBy("block").applyInArrow(run, PACKET)


def in_small_batches(run: Callable) -> Callable:
    """Packets are large rows, so while ``run`` works Spark sends few of them to Python at a time; large buffers would pile up beside the heap."""

    @wraps(run)
    def limited(first: DataFrame | Graph, *args: object, **named: object) -> object:
        conf, name = (first.nodes if isinstance(first, Graph) else first).sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
        before = conf.get(name, None)
        conf.set(name, str(MOST // 8))
        try:
            return run(first, *args, **named)
        finally:
            conf.unset(name) if before is None else conf.set(name, before)

    return limited


def kind(rows: DataFrame, *kinds: int) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds))


# ---------------------------------------------------------------- building


@dataclass
class Graph:
    count: int
    nodes: DataFrame  # node, vec, at: a row per distinct vector, and its number
    members: DataFrame  # node, vec_id: the smallest ids of each node
    vectors: DataFrame  # a packet per block: the vectors and node ids
    state: DataFrame  # a packet per block: the numbers and distances of each node's nearest
    degree: int

    @property
    def parts(self) -> int:
        return spread_over(self.nodes, -(-self.count // BLOCK))

    @property
    def edges(self) -> DataFrame:
        """u, v, d."""
        degree, ref = self.degree, reference(self.count)

        def run(key: tuple, table: pa.Table) -> pa.Table:
            ids, d, _ = state_of(table, degree, ref)
            slot, place = np.nonzero(ids >= 0)
            return pa.table({"u": slot + key[0].as_py() * BLOCK, "v": ids[slot, place], "d": d[slot, place].astype(np.float64)})

        rows = self.state.groupBy("block").applyInArrow(run, "u long, v long, d double")
        ends = [self.nodes.select(F.col("at").alias(c), F.col("node").alias(f"{c}_node")) for c in "uv"]
        return rows.join(ends[0], "u").join(ends[1], "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"), "d")


def spread_over(rows: DataFrame, blocks: int) -> int:
    """Partitions for so many blocks."""
    return max(1, min(blocks, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 4))))


def reference(count: int) -> type:
    return np.int32 if count < 1 << 31 else np.int64


def size_of(block: int, count: int) -> int:
    return min(BLOCK, count - block * BLOCK)


def planes_of(nodes: DataFrame, count: int, tables: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Random hyperplanes through the middle of a bounded sample, for each table."""
    sample = smallest(nodes.withColumn("at", F.xxhash64("node")), "at", 1_000).select("vec").toPandas()["vec"]
    sample = np.stack([np.asarray(v, np.float64) for v in sample]) if len(sample) else np.zeros((1, 1))
    bits = max(0, min(40, int(np.log2(max(1, count / (CELL / 2))))))
    planes = np.random.Generator(np.random.PCG64(seed)).normal(size=(tables, bits, sample.shape[1]))
    return [(p, np.median(sample @ p.T, axis=0) if bits else np.zeros(0)) for p in planes]


def cells_of(x: np.ndarray, planes: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return ((x @ planes.T > middle) @ (1 << np.arange(len(planes), dtype=np.int64))).astype(np.int64) if len(x) else np.zeros(0, np.int64)


def numbered(nodes: DataFrame, planes: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """node, vec, at: numbers without gaps, in the order of the first table's cells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = pa.array(cells_of(matrix(batch.column("vec")), *planes[0]))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("vec"), cell], ["node", "vec", "cell"])

    rows = nodes.mapInArrow(run, "node long, vec array<float>, cell long")
    rows = rows.repartitionByRange("cell", "node").sortWithinPartitions("cell", "node")
    rows = staged(rows.withColumn("place", F.monotonically_increasing_id()).select("node", "vec", "place"), "places")
    sizes = sorted((r["part"], r["count"]) for r in rows.groupBy(F.shiftright("place", 33).alias("part")).count().collect())
    names, starts = np.array([p for p, _ in sizes], np.int64), np.cumsum([0, *(n for _, n in sizes)])

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.asarray(batch.column("place"))
            at = starts[np.searchsorted(names, place >> 33)] + (place & ((1 << 33) - 1))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("vec"), pa.array(at, pa.int64())], ["node", "vec", "at"])

    nodes = staged(rows.mapInArrow(number, "node long, vec array<float>, at long"), "nodes")
    discard(rows)
    return nodes


def in_blocks(nodes: DataFrame, parts: int) -> DataFrame:
    """A packet of vectors (floats) and node ids per block."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("at").to_numpy())
        x = matrix(table.column("vec").combine_chunks()).astype(np.float32)[order]
        return packet(key[0].as_py(), VECTORS, key[0].as_py(), len(x), x, table.column("node").to_numpy().astype(np.int64)[order])

    rows = nodes.withColumn("block", (F.col("at") / BLOCK).cast("long")).repartition(parts, "block")
    return rows.groupBy("block").applyInArrow(run, PACKET)


def distances(x: np.ndarray) -> np.ndarray:
    """Squared distances in each of many lists; seen from its middle, so that vectors far from the origin lose no digits."""
    x = x - x.mean(axis=1, keepdims=True)
    squares = np.einsum("ijk,ijk->ij", x, x)
    d = np.matmul(x, x.transpose(0, 2, 1))
    d *= -2
    d += squares[:, :, None]
    d += squares[:, None, :]
    np.maximum(d, 0, out=d)
    middle = np.arange(d.shape[1])
    d[:, middle, middle] = np.inf
    return d


def celled(nodes: DataFrame, planes: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """at, vec, tab, cell, part: the cells of a node, and the parts into which they are cut at random where large."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"))
            for tab, plane in enumerate(planes):
                columns = [batch.column("at"), batch.column("vec"), pa.array(np.full(len(x), tab, np.int32)), pa.array(cells_of(x, *plane))]
                yield pa.RecordBatch.from_arrays(columns, ["at", "vec", "tab", "cell"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            cells, n = np.unique(np.asarray(batch.column("cell")), return_counts=True)
            tab = np.full(len(cells), batch.column("tab")[0].as_py() if len(cells) else 0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(tab), pa.array(cells), pa.array(n, pa.int64())], ["tab", "cell", "n"])

    sizes = nodes.mapInArrow(count, "tab int, cell long, n long").groupBy("tab", "cell").agg(F.ceil(F.sum("n") / CELL).alias("parts"))
    cells = nodes.mapInArrow(run, "at long, vec array<float>, tab int, cell long").join(sizes.where("parts > 1"), ["tab", "cell"], "left")
    return cells.withColumn("part", F.pmod(F.xxhash64("at"), F.coalesce("parts", F.lit(1)))).drop("parts")


def first_pairs(nodes: DataFrame, planes: list[tuple[np.ndarray, np.ndarray]], parts: int, degree: int, ref: type) -> DataFrame:
    """The nearest of a node in each of its cells."""
    most = -(-2 * degree // len(planes))  # tables agree on some, so twice as many as needed

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("at").to_numpy()
        k = min(most, len(ids) - 1)
        if k < 1:
            return SCHEMA.empty_table()
        order = np.argsort(ids)
        ids = ids[order]
        d = distances(matrix(table.column("vec").combine_chunks())[order][None])[0]
        best = np.argpartition(d, k - 1, axis=1)[:, :k]
        u = np.repeat(ids, k)
        return addressed(FOUND, 0, u // BLOCK, (u % BLOCK).astype(SLOT), ids[best].ravel().astype(ref), np.take_along_axis(d, best, 1).ravel().astype(np.float32))

    cells = celled(nodes, planes).repartition(parts, "tab", "cell", "part")  # or the parts of a large cell would stay in one task
    return cells.groupBy("tab", "cell", "part").applyInArrow(run, PACKET)


def state_of(table: pa.Table, degree: int, ref: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of each node of a block, nearest first (-1 where there are fewer), their distances and marks: 1 new, 2 sampled."""
    table = of(table, STATE)
    return (
        whole(table, "a", ref).reshape(-1, degree).astype(np.int64), whole(table, "b", np.float32).reshape(-1, degree),
        whole(table, "c", np.uint8).reshape(-1, degree),
    )


def keys_of(ids: np.ndarray) -> np.ndarray:
    """(place, node) as one number, for the nodes in each row; sorted."""
    slot, at = np.nonzero(ids >= 0)
    return np.sort(slot << BITS | ids[slot, at])


def unknown(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the keys aren't among the sorted ``known``."""
    if not len(known):
        return np.ones(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] != keys


def draws(u: np.ndarray, v: np.ndarray, new: np.ndarray, turn: int) -> np.ndarray:
    """The order in which edges come into a sample: new ones first, then by chance."""
    with np.errstate(over="ignore"):
        lot = mix64(mix64(u.astype(np.uint64) * np.uint64(2 * turn + 3)) ^ (v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(2)
    return lot.astype(np.int64) | np.where(new, 0, 1 << 62)


def merged(table: pa.Table, block: int, size: int, degree: int, ref: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest of each node of a block after what was found; also which are new, and how many of them come from this round."""
    ids, d, marks = state_of(table, degree, ref)
    if not len(ids):
        ids, d, marks = np.full((size, degree), -1), np.full((size, degree), np.inf, np.float32), np.zeros((size, degree), np.uint8)
    got = of(table, FOUND)
    key, gap = whole(got, "a", SLOT).astype(np.int64) << BITS | whole(got, "b", ref).astype(np.int64), whole(got, "c", np.float32)
    order = np.lexsort((gap, key))
    order = order[runs(key[order])[:-1]]
    order = order[unknown(key[order], keys_of(ids))]
    key, gap = key[order], gap[order]
    order = np.lexsort((key, gap, key >> BITS))
    slot, place = key[order] >> BITS, places(key[order] >> BITS)
    order, slot, place = order[place < degree], slot[place < degree], place[place < degree]
    wide = int(place.max(initial=-1)) + 1
    more, far = np.full((size, wide), -1), np.full((size, wide), np.inf, np.float32)
    more[slot, place], far[slot, place] = key[order] & ((1 << BITS) - 1), gap[order]
    all_d = np.concatenate([d, far], axis=1)
    best = np.argsort(all_d, axis=1, kind="stable")[:, :degree]
    ids = np.take_along_axis(np.concatenate([ids, more], axis=1), best, 1)
    waiting = np.concatenate([(marks == 1), np.ones(more.shape, bool)], axis=1)  # new, and in no sample yet
    return ids, np.take_along_axis(all_d, best, 1), np.take_along_axis(waiting, best, 1) & (ids >= 0), int(((best >= degree) & (ids >= 0)).sum())


def dealt(table: pa.Table, block: int, count: int, degree: int, sample: int, turn: int, ref: type) -> list[pa.Table]:
    """The state after what was found, with the edges of the next sample marked, and offers of edges to their other ends."""
    ids, d, new, fresh = merged(table, block, size_of(block, count), degree, ref)
    slots = np.arange(len(ids)) + block * BLOCK
    lot = np.where(ids >= 0, draws(slots[:, None], ids, new, turn), np.iinfo(np.int64).max)
    sampled = np.ones(ids.shape, bool)
    if degree > sample:
        sampled[:] = False
        np.put_along_axis(sampled, np.argpartition(lot, sample - 1, axis=1)[:, :sample], True, 1)
    slot, at = np.nonzero(ids >= 0)
    v, lot = ids[slot, at], lot[slot, at]
    state = packet(block, STATE, fresh, len(v), ids.astype(ref), d, new | (sampled << 1).astype(np.uint8))
    order = np.lexsort((lot, v))
    order = order[places(v[order]) < sample]  # a sample takes no more of one block
    v, slot, at = v[order], slot[order], at[order]
    return [state, addressed(OFFER, block, v // BLOCK, (v % BLOCK).astype(SLOT), slots[slot].astype(ref), new[slot, at].astype(np.uint8))]


def gathered(table: pa.Table, block: int, degree: int, sample: int, turn: int, ref: type) -> list[pa.Table]:
    """The samples around the nodes of a block, in both directions, and requests for their vectors."""
    ids, _, marks = state_of(table, degree, ref)
    got = of(table, OFFER)
    slot, u, new = whole(got, "a", SLOT).astype(np.int64), whole(got, "b", ref).astype(np.int64), whole(got, "c", np.uint8)
    order = np.lexsort((draws(u, slot + block * BLOCK, new > 0, turn), slot))
    place = places(slot[order])
    order, place = order[place < sample], place[place < sample]
    around, fresh = np.full((len(ids), 2 * sample), -1), np.zeros((len(ids), 2 * sample), bool)
    around[slot[order], sample + place], fresh[slot[order], sample + place] = u[order], new[order] > 0
    sampled = (marks > 1) & (ids >= 0)
    rows, at = np.nonzero(sampled)
    place = (np.cumsum(sampled, axis=1) - 1)[rows, at]
    around[rows, place], fresh[rows, place] = ids[rows, at], marks[rows, at] & 1
    order = np.argsort(around, axis=1, kind="stable")
    around, fresh = np.take_along_axis(around, order, 1), np.take_along_axis(fresh, order, 1)
    same = (around[:, 1:] == around[:, :-1]) & (around[:, 1:] >= 0)  # of both directions: the second stays
    fresh[:, 1:] |= fresh[:, :-1] & same
    around[:, :-1][same] = -1
    around[~fresh.any(axis=1)] = -1  # nothing is compared there
    asked = np.unique(around[around >= 0])
    return [packet(block, AROUND, block, 0, around.astype(ref), fresh), addressed(REQUEST, block, asked // BLOCK, (asked % BLOCK).astype(SLOT))]


def answered(table: pa.Table, block: int, degree: int, ref: type) -> Iterator[pa.Table]:
    """The vectors that other blocks ask for, and the distances below which an edge of theirs must be."""
    yield of(table, AROUND)
    _, d, _ = state_of(table, degree, ref)
    vectors, got = of(table, VECTORS), of(table, REQUEST)
    to, slot = per_item(got), whole(got, "a", SLOT).astype(np.int64)
    x = whole(vectors, "a", np.float32).reshape(len(d), -1)
    bounds = np.cumsum([0, *got.column("n").to_numpy()])
    for start, stop in slices(np.diff(bounds) * x.shape[1] * x.itemsize, MOST):
        some = slice(bounds[start], bounds[stop])
        yield addressed(ANSWER, block, to[some], (slot[some] + block * BLOCK).astype(ref), x[slot[some]], d[slot[some], -1])


def compared(table: pa.Table, block: int, degree: int, sample: int, best: int, ref: type) -> list[pa.Table]:
    """The pairs in each sample that are nearer than what a node has, for the node's block."""
    mine, got = of(table, AROUND), of(table, ANSWER)
    around, fresh = whole(mine, "a", ref).reshape(-1, 2 * sample), whole(mine, "b", np.uint8).reshape(-1, 2 * sample) > 0
    keep = (around >= 0).sum(axis=1) > 1
    around, fresh = around[keep], fresh[keep]
    names = whole(got, "a", ref)
    if not len(around):
        return []
    order = np.argsort(names)
    names, x, far = names[order], whole(got, "b", np.float32).reshape(len(names), -1), whole(got, "c", np.float32)[order]
    around = np.where(around < 0, around[:, -1:], around), around >= 0
    at, there = np.searchsorted(names, around[0]), around[1]
    keys, gaps = [], []
    middle = np.arange(2 * sample)
    for start in range(0, len(at), AT_ONCE):
        rows, real, new = at[start : start + AT_ONCE], there[start : start + AT_ONCE], fresh[start : start + AT_ONCE]
        d = distances(x[order[rows]].astype(np.float64)).astype(np.float32)
        better = d < far[rows][:, :, None]
        better &= new[:, :, None] | new[:, None, :]
        better &= real[:, :, None] & real[:, None, :]
        better[:, middle, middle] = False
        many = better.sum(axis=2) > best
        if many.any():
            some = np.where(better[many], d[many], np.inf)
            kept = np.zeros(some.shape, bool)
            np.put_along_axis(kept, np.argpartition(some, best - 1, axis=1)[:, :best], True, 1)
            better[many] = kept
        i, j, other = np.nonzero(better)
        keys.append(rows[i, j] * len(names) + rows[i, other])
        gaps.append(d[i, j, other])
    key, gap = np.concatenate(keys), np.concatenate(gaps)
    order = np.lexsort((gap, key))
    order = order[runs(key[order])[:-1]]
    key, gap = key[order], gap[order]
    a, b = np.divmod(key, len(names))
    order = np.lexsort((gap, a))
    order = order[places(a[order]) < degree]  # a node keeps no more of one block
    a, b, gap = names[a[order]].astype(np.int64), names[b[order]], gap[order]
    return [addressed(FOUND, block, a // BLOCK, (a % BLOCK).astype(SLOT), b, gap)]


def descend(state: DataFrame, blocks: DataFrame, parts: int, count: int, degree: int, sample: int, best: int, turn: int) -> DataFrame:
    """One round: neighbours of neighbours that are nearer than what a node has."""
    mine, ref = kind(state, STATE), reference(count)
    packets = each([state], parts, lambda b, t: gathered(t, b, degree, sample, turn, ref))
    packets = each([packets, mine, blocks], parts, lambda b, t: answered(t, b, degree, ref))
    packets = each([packets], parts, lambda b, t: compared(t, b, degree, sample, best, ref))
    return each([packets, mine], parts, lambda b, t: dealt(t, b, count, degree, sample, turn + 1, ref))


@in_small_batches
def build(
    vectors: DataFrame, *, keep: int = 11, degree: int = 64, sample: int = 32, best: int = 8, tables: int = 4,
    still: float = 0.05, rounds: int = 40, seed: int = 5,
) -> Graph:
    """The graph of all usable vectors; ``keep`` members of each node are kept for results.

    A sample holds at most ``sample`` neighbours per direction, each of which is offered its ``best`` nearest.
    Rounds go on until at most the share ``still`` of the edges is new; if that takes more than ``rounds``, it is an error.
    """
    rows = usable(vectors).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(3), "vec")})
    rows = rows.groupBy("vec_id").agg(F.min_by(F.struct("vec", "h1", "h2"), "h1").alias("x")).select("vec_id", "x.*")
    classes = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.min_by("vec", "vec_id").alias("vec"))
    classes = staged(classes, "classes")
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    members = rows.select("h1", "h2", "vec_id").withColumn("r", rank).where(F.col("r") <= keep)
    members = staged(members.join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("node", "vec_id"), "members")
    count = classes.count()
    planes, ref = planes_of(classes.select("node", "vec"), count, tables, seed), reference(count)
    nodes = numbered(classes.select("node", "vec"), planes)
    parts = spread_over(nodes, -(-count // BLOCK))
    blocks = staged(in_blocks(nodes, parts), "vectors")
    # A block of which nothing was found yet has an empty state.
    none = blocks.select("block", F.lit(STATE).alias("kind"), "src", F.lit(0).cast("long").alias("n"), *(F.lit(None).cast("binary").alias(c) for c in "abcde"))
    state = staged(each([none, first_pairs(nodes, planes, parts, degree, ref)], parts, lambda b, t: dealt(t, b, count, degree, sample, 0, ref)), "graph")
    for turn in range(rounds):
        older, state = state, staged(descend(state, blocks, parts, count, degree, sample, best, turn), "graph")
        discard(older)
        sums = kind(state, STATE).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum("src"), F.lit(0)).alias("fresh")).first()
        if sums["fresh"] <= still * sums["all"]:
            break
    else:
        raise RuntimeError(f"over {still:.2%} of the edges are still new after {rounds} rounds")
    return Graph(count, nodes, members, blocks, kind(state, STATE), degree)


# ---------------------------------------------------------------- searching


def adjacency(graph: Graph, ahead: int, back: int) -> DataFrame:
    """A packet per block: the nodes by which each of its nodes is left, one list after the other."""
    count, degree, ref = graph.count, graph.degree, reference(graph.count)

    def forward(block: int, table: pa.Table) -> list[pa.Table]:
        ids, d, _ = state_of(table, degree, ref)
        ids, d = ids[:, :ahead], d[:, :ahead]
        slot, at = np.nonzero(ids >= 0)
        v, u, gap = ids[slot, at], slot + block * BLOCK, d[slot, at]
        order = np.lexsort((u, gap, v))
        order = order[places(v[order]) < back]  # no node takes more of one block
        v, gap = v[order], gap[order]
        return [packet(block, STATE, block, 0, ids.astype(ref)), addressed(OFFER, block, v // BLOCK, (v % BLOCK).astype(SLOT), u[order].astype(ref), gap)]

    def both(block: int, table: pa.Table) -> list[pa.Table]:
        ids = whole(of(table, STATE), "a", ref).reshape(size_of(block, count), -1).astype(np.int64)
        got = of(table, OFFER)
        slot, u, gap = whole(got, "a", SLOT).astype(np.int64), whole(got, "b", ref).astype(np.int64), whole(got, "c", np.float32)
        order = np.lexsort((u, gap, slot))
        order = order[places(slot[order]) < back]
        keys = np.unique(np.concatenate([keys_of(ids), slot[order] << BITS | u[order]]))
        bounds = np.searchsorted(keys >> BITS, np.arange(len(ids) + 1))
        return [packet(block, ADJACENT, block, 0, bounds.astype(np.int32), (keys & ((1 << BITS) - 1)).astype(ref))]

    return staged(each([each([graph.state], graph.parts, forward)], graph.parts, both), "adjacent")


def asked_of(table: pa.Table) -> np.ndarray:
    """Records of the queries in packets of beams: q, how often it is asked (times), its vector x."""
    count, data = int(table.column("src").to_numpy().sum()), whole(table, "e", np.uint8)
    return data.view([("q", np.int64), ("times", np.int64), ("x", np.float32, (len(data) // max(1, count) - 16) // 4)])


@dataclass
class Beams:
    """The nearest nodes found for a group of queries, nearest first; -1 where there are fewer."""

    asked: np.ndarray
    at: np.ndarray
    marks: np.ndarray  # 1: expanded, 2: held by the last beam, 4: a start
    node: np.ndarray
    d: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, kind: int, ref: type) -> Beams:
        rows = of(table, kind)
        asked = asked_of(rows)
        at, *more = (whole(rows, c, t).reshape(len(asked), -1) for c, t in zip("abcd", (ref, np.uint8, np.int64, np.float64), strict=True))
        return cls(asked, at.astype(np.int64), *more)

    def widened(self, wide: int) -> Beams:
        more = ((0, 0), (0, wide - self.at.shape[1]))
        return Beams(self.asked, *(np.pad(x, more, constant_values=v) for x, v in ((self.at, -1), (self.marks, 0), (self.node, -1), (self.d, np.inf))))

    def with_found(self, i: np.ndarray, at: np.ndarray, node: np.ndarray, d: np.ndarray) -> Beams:
        """After nodes were measured for the ``i``-th queries, those of the same query all different."""
        wide = self.at.shape[1]
        new = unknown(i << BITS | at, keys_of(self.at)) & (d <= self.d[i, -1])
        i, at, node, d = i[new], at[new], node[new], d[new]
        slot, place = np.nonzero(self.at >= 0)
        old = (slot, self.at[slot, place], self.marks[slot, place], self.node[slot, place], self.d[slot, place])
        i, at, marks, node, d = (np.concatenate(c) for c in zip(old, (i, at, np.zeros(len(i), np.uint8), node, d), strict=True))
        order = np.lexsort((node, d, i))
        place = places(i[order])
        order, place = order[place < wide], place[place < wide]
        out = Beams(self.asked, np.full_like(self.at, -1), np.zeros_like(self.marks), np.full_like(self.node, -1), np.full_like(self.d, np.inf))
        out.at[i[order], place], out.marks[i[order], place], out.node[i[order], place], out.d[i[order], place] = at[order], marks[order], node[order], d[order]
        return out

    def sent(self, group: int, beam: int, shard: int, ref: type) -> list[pa.Table]:
        """The beams as packets, and those nodes to be expanded, to their shards; they are marked as expanded.

        Queries whose beam is done rest in a packet of their own until the beam is doubled.
        """
        i, place = np.nonzero((self.at[:, :beam] >= 0) & (self.marks[:, :beam] & 1 == 0))
        at = self.at[i, place]
        self.marks[i, place] |= 1
        going = np.zeros(len(self.asked), bool)
        going[i] = True
        i = (np.cumsum(going) - 1)[i]
        order = np.argsort(at // shard, kind="stable")
        out = [addressed(EXPAND, group, at[order] // shard, i[order].astype(SLOT), at[order].astype(ref))]
        for some, kind, n in ((going, STATE, len(i)), (~going, RESTING, 0)):
            if some.any():
                out.append(packet(group, kind, int(some.sum()), n, self.at[some].astype(ref), self.marks[some], self.node[some], self.d[some], self.asked[some]))
        return out


def begun(graph: Graph, asked: DataFrame, groups: int, starts: int, beam: int, shard: int, ref: type) -> DataFrame:
    """The first beams: the nearest of the landmarks, which are few whatever the size of the graph, and the query's own node."""
    own = graph.members.select(F.col("vec_id").alias("q"), "node").join(asked.select("q").distinct(), "q").join(graph.nodes, "node")
    rows = asked.join(own.select("q", "node", "at", "vec"), "q", "left").withColumn("block", F.pmod(F.xxhash64("q", "qvec"), F.lit(groups)))
    landmarks = smallest(graph.nodes.withColumn("by", F.xxhash64("node")), "by", LANDMARKS).collect()
    names, numbers = (np.array([r[c] for r in landmarks], np.int64) for c in ("node", "at"))
    marks = np.array([r["vec"] for r in landmarks], np.float64)
    most = min(starts, len(names))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("q").to_numpy())
        table = table.take(pa.array(order))
        q, x, times = table.column("q").to_numpy(), matrix(table.column("qvec").combine_chunks()), table.column("times").to_numpy()
        i, at, node, d = [], [], [], []
        for j in range(len(q) if most else 0):
            gap = x[j] - marks
            gap = np.sqrt((gap * gap).sum(axis=1))
            near = np.argsort(gap, kind="stable")[:most]
            i, at, node, d = [*i, np.full(most, j)], [*at, numbers[near]], [*node, names[near]], [*d, gap[near]]
        mine = np.flatnonzero(table.column("at").is_valid().to_numpy())
        if len(mine):
            table = table.take(pa.array(mine))
            gap = x[mine] - matrix(table.column("vec").combine_chunks())
            i, at, node = [*i, mine], [*at, table.column("at").to_numpy()], [*node, table.column("node").to_numpy()]
            d = [*d, np.sqrt((gap * gap).sum(axis=1))]
        i, at, node, d = (np.concatenate([np.zeros(0, t), *c]) for c, t in zip((i, at, node, d), (np.int64, np.int64, np.int64, float), strict=True))
        first = np.unique(i << BITS | at, return_index=True)[1]
        empty = [np.full((len(q), 2 * beam), v) for v in (-1, -1, np.inf)]
        asked = np.zeros(len(q), [("q", np.int64), ("times", np.int64), ("x", np.float32, x.shape[1])])
        asked["q"], asked["times"], asked["x"] = q, times, x
        beams = Beams(asked, empty[0], np.zeros((len(q), 2 * beam), np.uint8), *empty[1:])
        beams = beams.with_found(i[first], at[first], node[first], d[first])
        beams.marks[beams.at >= 0] = 4
        return pa.concat_tables(beams.sent(key[0].as_py(), beam, shard, ref))

    return rows.repartition(spread_over(rows, groups), "block").groupBy("block").applyInArrow(run, PACKET)


def onward(table: pa.Table, at: int, shard: int, ref: type) -> list[pa.Table]:
    """The next nodes of those that queries expand, to the queries' groups."""
    lists, got = of(table, ADJACENT), of(table, EXPAND)
    starts, stops, base, ids = np.zeros(shard, np.int64), np.zeros(shard, np.int64), 0, [np.zeros(0, ref)]
    for row in range(len(lists)):
        one = lists.slice(row, 1)
        first, bounds = one.column("src")[0].as_py() * BLOCK - at * shard, whole(one, "a", np.int32).astype(np.int64)
        starts[first : first + len(bounds) - 1], stops[first : first + len(bounds) - 1] = bounds[:-1] + base, bounds[1:] + base
        ids.append(whole(one, "b", ref))
        base += len(ids[-1])
    ids = np.concatenate(ids)
    group, i, place = per_item(got), whole(got, "a", SLOT), whole(got, "b", ref).astype(np.int64) - at * shard
    order = np.argsort(group, kind="stable")
    group, i, place = group[order], i[order], place[order]
    counts = stops[place] - starts[place]
    ends = np.cumsum(counts)
    pick = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[place] - (ends - counts), counts)
    return [addressed(ANSWER, at, np.repeat(group, counts), np.repeat(i, counts), ids[pick])]


def wanted(table: pa.Table, group: int, shard: int, ref: type) -> list[pa.Table]:
    """The nodes that a group's queries haven't found yet, to their shards, with the vectors of those queries."""
    mine, got = of(table, STATE), of(table, ANSWER)
    queries = asked_of(mine)["x"]
    keys = np.unique(whole(got, "a", SLOT).astype(np.int64) << BITS | whole(got, "b", ref).astype(np.int64))
    keys = keys[unknown(keys, keys_of(whole(mine, "a", ref).reshape(len(queries), -1).astype(np.int64)))]
    i, at = keys >> BITS, keys & ((1 << BITS) - 1)
    order = np.argsort(at // shard, kind="stable")
    i, at = i[order], at[order]
    rows = addressed(REQUEST, group, at // shard, i.astype(SLOT), at.astype(ref))
    bounds, who = runs(at // shard), []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        who.append(i[a:b][runs(i[a:b])[:-1]])
    ends, who = np.cumsum([0, *map(len, who)]), np.concatenate([np.zeros(0, np.int64), *who])
    return [rows.set_column(6, SCHEMA.field(6), binaries(queries[who], ends)).set_column(7, SCHEMA.field(7), binaries(who.astype(SLOT), ends))]


def measured(table: pa.Table, at: int, shard: int, ref: type) -> list[pa.Table]:
    """The Euclidean distances, in double precision, of the nodes that queries want, to the queries' groups."""
    blocks, got = of(table, VECTORS), of(table, REQUEST)
    base = {b: start for b, start in zip(blocks.column("src").to_pylist(), np.cumsum([0, *blocks.column("n").to_numpy()])[:-1], strict=True)}
    names, starts = whole(blocks, "b", np.int64), np.zeros(shard // BLOCK, np.int64)
    x = whole(blocks, "a", np.float32).reshape(len(names), -1)
    for b, start in base.items():
        starts[b - at * shard // BLOCK] = start
    out = []
    for row in range(len(got)):
        one = got.slice(row, 1)
        group, who = one.column("src")[0].as_py(), whole(one, "d", SLOT)
        i, number = whole(one, "a", SLOT), whole(one, "b", ref)
        queries = whole(one, "c", np.float32).reshape(len(who), -1).astype(np.float64)
        mine, place = np.searchsorted(who, i), number.astype(np.int64) - at * shard
        place = starts[place // BLOCK] + place % BLOCK
        d = np.empty(len(i))
        for start in range(0, len(i), BLOCK):
            some = slice(start, start + BLOCK)
            gap = queries[mine[some]] - x[place[some]]
            d[some] = np.sqrt((gap * gap).sum(axis=1))
        out.append(packet(group, FOUND, at, len(i), i, number, names[place], d))
    return out


def hop(found: DataFrame, index: tuple[DataFrame, DataFrame], parts: tuple[int, int], beam: int, shard: int, ref: type) -> DataFrame:
    """The beams after those nodes were expanded that were sent to be."""
    state, (adjacent, vectors), (shards, groups) = kind(found, STATE), index, parts
    known = state.withColumns({c: F.lit(None).cast("binary") for c in "bcd"})

    def absorbed(group: int, table: pa.Table) -> list[pa.Table]:
        got = of(table, FOUND)
        i, at = whole(got, "a", SLOT).astype(np.int64), whole(got, "b", ref).astype(np.int64)
        beams = Beams.of(table, STATE, ref).with_found(i, at, whole(got, "c", np.int64), whole(got, "d", np.float64))
        return beams.sent(group, beam, shard, ref)

    packets = each([kind(found, EXPAND), adjacent], shards, lambda b, t: onward(t, b, shard, ref))
    packets = each([packets, known], groups, lambda b, t: wanted(t, b, shard, ref))
    packets = each([packets, vectors], shards, lambda b, t: measured(t, b, shard, ref))
    return each([packets, state], groups, absorbed)


def doubled(found: list[DataFrame], groups: int, beam: int, top: int, shard: int, ref: type) -> DataFrame:
    """Beams of twice the width that hold the ``top`` nearest; a packet has how many these are, and how many the last beam didn't hold."""

    def run(group: int, table: pa.Table) -> list[pa.Table]:
        beams = Beams.of(table, RESTING, ref)
        near = beams.at[:, :top] >= 0
        new = near & (beams.marks[:, :top] & 2 == 0)
        beams.marks &= 1 | 4
        beams.marks[:, :top][near] |= 2
        return [packet(group, COUNTED, int(new.sum()), int(near.sum())), *beams.widened(4 * beam).sent(group, 2 * beam, shard, ref)]

    return each([kind(f, RESTING) for f in found], groups, run)


@in_small_batches
def search(
    graph: Graph, queries: DataFrame, *, k: int = 10, beam: int = 192, settled: float = 0.02, starts: int = 8, ahead: int = 30, back: int = 40,
    hops: int = 200,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found; ``queries`` has vec_id and embedding.

    The search ends with the first beam that brings in at most the share ``settled`` of the nearest nodes; ``beam`` is
    the first width. A node is left by its ``ahead`` nearest edges and by its ``back`` nearest reversed ones, so that a hub
    costs no more than others; the other edges only serve to find these. A beam that isn't done after ``hops`` is an error.
    The rows of a repeated id in ``queries`` are all asked, and their results ranked together: a row that comes twice
    brings in each node twice that it didn't start from.
    """
    asked = usable(queries).groupBy(F.col("vec_id").alias("q"), F.col("vec").alias("qvec")).agg(F.count("*").alias("times"))
    asked = staged(asked, "queries")
    ref, blocks = reference(graph.count), -(-graph.count // BLOCK)
    groups = max(1, -(-asked.count() // GROUP))
    # Nodes of a shard: the more blocks there are, the more of them, so that a query's vector travels to few.
    together = min(SHARD, max(1, blocks // 64))
    shard, shards = BLOCK * together, spread_over(asked, -(-blocks // together))
    to_shard = (F.col("block") / together).cast("long")
    adjacent = adjacency(graph, ahead, back).withColumn("block", to_shard)
    vectors = graph.vectors.withColumn("block", to_shard)
    dealt_to = spread_over(asked, groups)
    found = staged(begun(graph, asked, groups, starts, beam, shard, ref), "beam")
    while True:
        kept = [found]  # all of them, as each holds the queries that were done by then
        for _ in range(hops):
            if not kind(found, STATE).agg(F.sum("n")).first()[0]:
                break
            found = staged(hop(found, (adjacent, vectors), (shards, dealt_to), beam, shard, ref), "beam")
            kept.append(found)
        else:
            raise RuntimeError(f"a search isn't done after {hops} hops")
        found = staged(doubled(kept, dealt_to, beam, k + 1, shard, ref), "beam")
        discard(*kept)
        count = kind(found, COUNTED).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum("src"), F.lit(0)).alias("new")).first()
        if count["new"] <= settled * count["all"]:
            break
        beam *= 2

    def nearest(table: pa.Table) -> pa.Table:
        return pa.concat_tables([results(Beams.of(table, kind, ref)) for kind in (STATE, RESTING) if len(of(table, kind))])

    def results(beams: Beams) -> pa.Table:
        # Own node included, k + 1 nodes hold the k nearest others; equal distances bring in no other node.
        i, place = np.nonzero(beams.at[:, : k + 1] >= 0)
        times = np.where(beams.marks[i, place] & 4, 1, np.minimum(beams.asked["times"][i], k + 1))
        i, place = np.repeat(i, times), np.repeat(place, times)
        return pa.table({"q": beams.asked["q"][i], "node": beams.node[i, place], "d": beams.d[i, place]})

    hits = kind(found, STATE, RESTING).groupBy("block").applyInArrow(nearest, "q long, node long, d double")
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "node"))).where(F.col("r") <= k + 1)
    hits = hits.join(graph.members, "node").where("vec_id <> q")
    hits = hits.select(F.col("q").alias("query_id"), "vec_id", F.col("d").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return hits.select("query_id", "rank", "vec_id", "score")
