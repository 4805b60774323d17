"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Components become whole numbers x = floor(64 * c) + 1000000. Over each distinct vector once, tasks add up exact sums and
products; from them comes the integer scatter n * sum(y y') - sum(y) sum(y)', which is n**2 times the covariance V, with
y = x - 1000000. Its characteristic polynomial is worked out modulo many primes (Hessenberg form, then the
recurrence of its leading minors), a task per few primes, and put together by Chinese remaindering. The number of
primes comes from a bound on the coefficients. All roots are real, so the changes of sign of the polynomial shifted to a
point count the roots above it exactly (Descartes); bisection by that count isolates the largest roots, and bisection
by sign narrows them. A component is the null space of scatter - root, found by inverse iteration in decimals of 120
digits; roots that agree to 30 digits share a space whose basis is made orthonormal.

Sums are exact whole numbers of any size, so nothing is lost by cancellation and any order of rows or recomputed task
gives the same components. What reaches the driver depends on the dimension alone, never on the rows.

Vectors that are NULL or hold NULL or non-finite components are left out, and so are those with a component whose x
is no long, or with another length than most (the shorter of equally common ones). Every other row is returned, repeated
ones and those without ``vec_id`` too. Components of eigenvalue 0 can't be whitened and are left out; so one distinct
vector, or an empty table, gives no rows. Columns other than ``vec_id`` and ``embedding`` are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.llm.common import staged

SCALE, SHIFT = 64, 1_000_000
#: Bits of a limb: products of two limbs, summed over a block of rows, stay below 2**53.
LIMB, BLOCK = 20, 4_096
#: Roots that agree to so many bits share a space; each is narrowed to so many bits.
TOGETHER, NARROW = 100, 160
DIGITS = 120
ROWS = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


# ---------------------------------------------------------------- whole numbers


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, x of the rows that take part."""

    def fits(c: Column) -> Column:
        return c.isNotNull() & (F.abs(c.cast("double")) < float(1 << 56))  # false for NaN and infinities

    x = F.transform("embedding", lambda c: F.when(fits(c), F.floor(c.cast("double") * SCALE) + SHIFT))
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(fits(c), F.lit(False)))
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (most["d"] if most else 0))


def shifted(column: pa.Array) -> np.ndarray:
    """y of each row; |y| stays below 2**62."""
    if len(column) == 0:
        return np.zeros((0, 0), np.int64)
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1) - SHIFT


def products(y: np.ndarray) -> np.ndarray:
    """y' y exactly, as Python's whole numbers; limbs of 20 bits go through products of doubles."""
    limbs, rest = [], y
    while True:
        low = ((rest + (1 << LIMB - 1)) & ((1 << LIMB) - 1)) - (1 << LIMB - 1)
        limbs.append(low.astype(np.float64))
        rest = (rest - low) >> LIMB
        if not rest.any():
            break
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return total


def moments(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums and products of y over the fit list; tasks send their sums, and Spark adds them up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, pairs = 0, 0, 0
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                y = shifted(batch.column("x").slice(start, BLOCK))
                n, sums, pairs = n + len(y), sums + y.astype(object).sum(axis=0), pairs + products(y)
        if n:
            cells = [(-1, -1, n), *((-1, j, s) for j, s in enumerate(sums))]
            cells += [(i, j, pairs[i, j]) for i in range(len(sums)) for j in range(i + 1)]
            parts = [[Decimal(int(v) >> 60) for *_, v in cells], [Decimal(int(v) & ((1 << 60) - 1)) for *_, v in cells]]
            columns = [pa.array([c[k] for c in cells], pa.int32()) for k in (0, 1)] + [pa.array(p, pa.decimal128(38, 0)) for p in parts]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "high", "low"])

    rows = fit.mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    cells = {(r[0], r[1]): (int(r[2]) << 60) + int(r[3]) for r in rows.groupBy("i", "j").agg(F.sum("high"), F.sum("low")).collect()}
    d = max((j for _, j in cells), default=-1) + 1
    pairs = np.array([[cells[max(i, j), min(i, j)] for j in range(d)] for i in range(d)], object).reshape(d, d)
    return cells.get((-1, -1), 0), [cells[-1, j] for j in range(d)], pairs


# ---------------------------------------------------------------- the polynomial


def primes_below(top: int) -> Iterator[int]:
    sieve = np.ones(math.isqrt(top) + 1, bool)
    sieve[:2] = False
    for k in range(2, math.isqrt(len(sieve)) + 1):
        if sieve[k]:
            sieve[k * k :: k] = False
    small = np.flatnonzero(sieve)
    for p in range(top - 1, 1, -1):
        if (p % small[small < p]).all():
            yield p


def primes_for(trace: int, d: int) -> list[int]:
    """Primes whose product exceeds twice every coefficient.

    The k-th symmetric sum of ``d`` roots that aren't negative is largest where all are equal, so it
    is at most binomial(d, k) * (trace / d) ** k.
    """
    bound = max(math.comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))
    product, out = 1, []
    for p in primes_below(1 << 31):
        if product > 2 * bound:
            return out
        product *= p
        out.append(p)
    raise ValueError("a trace that needs more primes than there are below 2**31")


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo a prime below 2**31, lowest first."""
    h, d = np.array(matrix % p, np.int64), len(matrix)
    for m in range(1, d - 1):
        filled = np.flatnonzero(h[m:, m - 1])
        if not len(filled):
            continue
        pivot = m + filled[0]
        h[[pivot, m]] = h[[m, pivot]]
        h[:, [pivot, m]] = h[:, [m, pivot]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for m in range(1, d + 1):
        polys[m, 1:] = polys[m - 1, :-1]
        factors, t = [int(h[m - 1, m - 1])], 1
        for i in range(m - 1, 0, -1):
            t = t * int(h[i, i - 1]) % p
            factors.append(t * int(h[i - 1, m - 1]) % p)
        polys[m] = (polys[m] - (np.array(factors)[:, None] * polys[m - 1 :: -1][:m] % p).sum(axis=0)) % p
    return polys[d].tolist()


def characteristic(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """The polynomial's coefficients, lowest first: residues from the tasks, put together here."""
    primes = primes_for(int(np.trace(matrix)), len(matrix))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").to_pylist()
            rests = pa.array([polynomial_modulo(matrix, q) for q in p], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("p"), rests], ["p", "rests"])

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 1 + len(primes) // 8))
    rests = {r["p"]: r["rests"] for r in rows.mapInArrow(run, "p long, rests array<long>").collect()}
    product = math.prod(primes)
    parts = [(product // p) * pow(product // p, -1, p) for p in primes]
    whole = [sum(part * rests[p][k] for part, p in zip(parts, primes, strict=True)) % product for k in range(len(matrix) + 1)]
    return [c - product if 2 * c > product else c for c in whole]


# ---------------------------------------------------------------- its roots


def at_scale(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2**bits times as large, in whole numbers."""
    return [c << bits * (len(poly) - 1 - k) for k, c in enumerate(poly)]


def sign_at(poly: list[int], point: Fraction) -> int:
    bits = point.denominator.bit_length() - 1
    value = 0
    for c in reversed(at_scale(poly, bits)):
        value = value * point.numerator + c
    return (value > 0) - (value < 0)


def roots_above(poly: list[int], point: Fraction) -> int:
    """Roots above a dyadic point, with their multiplicity: changes of sign after a shift to it.

    Descartes' rule is exact here, since the roots of a symmetric matrix are all real.
    """
    bits = point.denominator.bit_length() - 1
    c = at_scale(poly, bits)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += point.numerator * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], most: int) -> list[tuple[Fraction, int]]:
    """The ``most`` largest positive roots with their multiplicity, in falling order, each to 160 bits."""
    top = Fraction(1 << max(1, -poly[-2]).bit_length())  # above the trace
    out: list[tuple[Fraction, int]] = []
    todo = [(Fraction(0), top, roots_above(poly, Fraction(0)), 0)]
    while todo:
        low, high, above_low, above_high = todo.pop()  # the highest range is on top
        if above_low == above_high or above_high >= most:
            continue
        middle = (low + high) / 2
        if above_low - above_high > 1 and high - low > low / (1 << TOGETHER):
            between = roots_above(poly, middle)
            todo += [(low, middle, above_low, between), (middle, high, between, above_high)]
            continue
        if above_low - above_high == 1:
            under = -1 if above_low % 2 else 1  # the sign just above ``low``, as all later roots lie above it
            while high - low > low / (1 << NARROW):
                sign = sign_at(poly, middle)
                low, high = (middle, high) if sign == under else (low, middle)
                if sign == 0:
                    low = middle
                middle = (low + high) / 2
        out.append((middle, min(above_low, most) - above_high))
    return out


# ---------------------------------------------------------------- its vectors


def start_vector(d: int, k: int) -> np.ndarray:
    draws = np.random.Generator(np.random.PCG64(k)).integers(-(1 << 40), 1 << 40, d)
    return np.array([Decimal(int(v)) for v in draws], object)


def null_space(matrix: np.ndarray, root: Fraction, size: int) -> list[list[float]]:
    """An orthonormal basis of the null space of matrix - root, by inverse iteration."""
    with localcontext(Context(prec=DIGITS)):
        value = Decimal(root.numerator) / Decimal(root.denominator)
        d = len(matrix)
        a = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
        a[np.diag_indices(d)] -= value
        tiny, order = value.scaleb(-DIGITS // 2), np.arange(d)
        for k in range(d):
            pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])

        def solved(b: np.ndarray) -> np.ndarray:
            x = b[order]
            for k in range(1, d):
                x[k] -= a[k, :k] @ x[:k]
            for k in range(d - 1, -1, -1):
                x[k] = (x[k] - (a[k, k + 1 :] @ x[k + 1 :] if k + 1 < d else 0)) / a[k, k]
            return x

        basis = [start_vector(d, k) for k in range(size)]
        for _ in range(5):
            for k in range(size):
                x = solved(basis[k])
                for _ in range(2):
                    for other in basis[:k]:
                        x = x - other * (other @ x)
                    x = x / (x @ x).sqrt()
                basis[k] = x
        return [[float(v) for v in x] for x in basis]


def spaces(spark: SparkSession, matrix: np.ndarray, roots: list[tuple[Fraction, int]]) -> list[np.ndarray]:
    """The components of all roots in their order, a task per root; the largest entry is positive."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("k").to_pylist()
            found = pa.array([null_space(matrix, *roots[r]) for r in k], pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([batch.column("k"), found], ["k", "found"])

    rows = spark.createDataFrame([(k,) for k in range(len(roots))], "k int").repartition(len(roots))
    found = {r["k"]: r["found"] for r in rows.mapInArrow(run, "k int, found array<array<double>>").collect()}
    vectors = [np.array(v) for k in range(len(roots)) for v in found[k]]
    return [v * np.sign(v[np.abs(v).argmax()]) for v in vectors]


# ---------------------------------------------------------------- fitting and whitening


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of y
    axes: np.ndarray  # a column per component
    values: np.ndarray  # eigenvalues of V
    explained: np.ndarray
    identity_error: float

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - sums, exactly; Python's whole numbers where 64 bits don't do."""
        high = max(int(np.abs(y).max(initial=0)) * self.n, *(abs(s) for s in self.sums))
        if high >= 1 << 61:
            return y.astype(object) * self.n - np.array(self.sums, object)
        return y * self.n - np.array(self.sums, np.int64)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ (self.axes / np.sqrt(self.values))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((k + 1, k))
        for batch in batches:
            if len(batch):
                w = model.whitened(model.centred(shifted(batch.column("x"))))
                pairs += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(pairs.shape)
        columns = [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(pairs.ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "v"])

    got = np.zeros((k + 1, k))
    for r in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        got[r[0], r[1]] = r[2] / model.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def fit(rows: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of vec_id, x; None if no component has a positive eigenvalue."""
    spark = rows.sparkSession
    distinct = staged(rows.select("x").distinct(), "fit-list")
    n, sums, pairs = moments(distinct)
    scatter = pairs * n - np.outer(np.array(sums, object), np.array(sums, object)) if n else pairs
    if not scatter.any():
        return None
    trace, common = int(np.trace(scatter)), math.gcd(*(int(v) for v in scatter.ravel()))
    scatter = scatter // common
    roots = largest_roots(characteristic(spark, scatter), components)
    axes = np.stack(spaces(spark, scatter, roots), axis=1)
    values = [root * common for root, times in roots for _ in range(times)]
    model = Whitening(
        n, sums, axes, np.array([float(v / n**2) for v in values]), np.array([float(v / trace) for v in values]), 0.0
    )
    model.identity_error = identity_error(distinct, model)
    return model


def whiten(vectors: DataFrame, *, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per row and component."""
    rows = whole(vectors)
    model = fit(rows, components)
    if model is None:
        error, run = 0.0, lambda batches: iter(())
    else:
        error, k = model.identity_error, len(model.values)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), BLOCK):
                    part = batch.slice(start, BLOCK)
                    centred = model.centred(shifted(part.column("x")))
                    size = int(np.abs(centred).max())
                    if size * size * centred.shape[1] >= 1 << 63:
                        centred = centred.astype(object)
                    squares = (centred * centred).sum(axis=1)
                    if squares.dtype == object:
                        deviation = pa.array([Decimal(int(v)) for v in squares], pa.decimal128(38, 0))
                    else:
                        deviation = pa.array(squares).cast(pa.decimal128(38, 0))
                    each = pa.array(np.repeat(np.arange(len(part)), k))
                    columns = [
                        part.column("vec_id").take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                        pa.array(np.full(len(part) * k, model.n)),
                        deviation.take(each),
                        pa.array(model.whitened(centred).ravel()),
                        pa.array(np.tile(model.explained, len(part))),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.mapInArrow(run, ROWS).withColumn("identity_error", F.lit(error))
