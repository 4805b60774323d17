from decimal import Decimal
from fractions import Fraction

import numpy as np
from almanack.llm import whitening
from almanack.llm.whitening import characteristic, largest_roots, moments, null_space, products, whiten, whole

SCHEMA = "vec_id long, embedding array<double>, x string, n int"


def frame(spark, rows):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1) for i, v in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(rows, most=16):
    """n, explained, and deviation and whitened per row, with numpy's solver; components up to sign."""
    x = {k: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for k, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    out = {k: (int(((n * r - sums) ** 2).sum()), (r - sums / n) @ axes / np.sqrt(values)) for k, r in x.items()}
    return n, values / np.trace(v), out


def vectors(count, d, seed=0, spread=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, d)) * (np.linspace(2, 0.2, d) if spread is None else spread)
    return [(i, v) for i, v in enumerate(x.tolist())]


def same_as_brute(got, rows, most=16):
    n, explained, per_row = brute(rows, most)
    found = {}
    for r in got:
        found.setdefault(r["vec_id"], []).append(r)
    assert set(found) == set(per_row)
    signs = None
    for vec_id, (deviation, whitened) in per_row.items():
        rs = sorted(found[vec_id], key=lambda r: r["component"])
        assert [r["component"] for r in rs] == list(range(1, len(explained) + 1))
        assert {(r["n"], int(r["deviation"])) for r in rs} == {(n, deviation)}
        mine = np.array([r["whitened"] for r in rs])
        if signs is None:
            signs = np.sign(mine * whitened)
        assert np.allclose(mine * signs, whitened, atol=1e-8)
        assert np.allclose([r["explained"] for r in rs], explained, rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_equals_numpy(llm_spark):
    rows = vectors(200, 20)
    same_as_brute(whiten(frame(llm_spark, rows)).collect(), rows)


def test_copies_and_odd_rows(llm_spark):
    rows = vectors(40, 4, seed=3)
    copies = [(1000 + i, rows[0][1]) for i in range(60)]
    bad = [(2000, None), (2001, [1, None, 2, 3]), (2002, [float("nan"), 0, 0, 0]), (2003, [float("inf"), 0, 0, 0]), (2004, [1, 2]), (2005, []), (2006, [1e300, 0, 0, 0])]
    got = whiten(frame(llm_spark, rows + copies + bad)).collect()
    same_as_brute(got, rows + copies)
    # Rows without an id and repeated rows are returned as they are.
    got = whiten(frame(llm_spark, [*rows, (None, rows[1][1]), rows[2]])).collect()
    assert sum(r["vec_id"] is None for r in got) == 4 and sum(r["vec_id"] == rows[2][0] for r in got) == 8


def test_degenerate_tables(llm_spark):
    assert whiten(frame(llm_spark, [])).count() == 0
    assert whiten(frame(llm_spark, [(1, None), (2, [])])).count() == 0
    assert whiten(frame(llm_spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0
    # Two distinct vectors span one component, whatever the dimension.
    got = whiten(frame(llm_spark, [(1, [0, 0, 0]), (2, [1, 2, 2]), (3, [1, 2, 2])])).collect()
    assert {r["component"] for r in got} == {1} and {r["explained"] for r in got} == {1.0}
    assert sorted(round(abs(r["whitened"]), 12) for r in got) == [1.0, 1.0, 1.0]


def test_equal_eigenvalues_have_an_orthonormal_basis(llm_spark):
    corners = [[a, b, c / 2] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    got = whiten(frame(llm_spark, list(enumerate(corners)))).collect()
    assert got[0]["identity_error"] < 1e-12
    assert sorted({round(r["explained"], 12) for r in got}) == [round(0.25 / 2.25, 12), round(1 / 2.25, 12)]
    assert {r["component"] for r in got} == {1, 2, 3}


def test_very_close_eigenvalues(llm_spark):
    a = np.array([[10**12, 0, 1], [0, 10**12 + 1, 0], [1, 0, 10**12 + 3]], object)
    roots = largest_roots(characteristic(llm_spark, a), 3)
    assert [m for _, m in roots] == [1, 1, 1]
    basis = np.array([null_space(a, *r)[0] for r in roots])
    assert np.abs(basis @ basis.T - np.eye(3)).max() < 1e-15
    assert np.allclose(np.abs(basis[1]), [0, 1, 0], atol=1e-15)


def test_polynomial_is_exact(llm_spark):
    rng = np.random.default_rng(1)
    b = rng.integers(-50, 50, (6, 9)).astype(object)
    a = b @ b.T
    poly = characteristic(llm_spark, a)
    # Faddeev and LeVerrier's recurrence, in whole numbers.
    m, want = np.zeros_like(a), [1]
    for k in range(1, 7):
        m = a @ m + want[-1] * np.eye(6, dtype=int).astype(object)
        want.append(-int(np.trace(a @ m)) // k)
    assert poly == want[::-1]
    roots = largest_roots(poly, 3)
    assert np.allclose([float(r) for r, _ in roots], np.linalg.eigvalsh(a.astype(float))[::-1][:3], rtol=1e-12)


def test_roots_with_multiplicity():
    def poly(*roots):
        p = [1]
        for r in roots:
            p = [a - r * b for a, b in zip([0, *p], [*p, 0], strict=True)]
        return p

    roots = largest_roots(poly(0, 0, 3, 5, 5, 5, 8), 16)
    assert [(round(float(r), 9), m) for r, m in roots] == [(8, 1), (5, 3), (3, 1)]
    assert [m for _, m in largest_roots(poly(0, 3, 5, 5, 5, 8), 3)] == [1, 2]
    assert largest_roots(poly(0, 0), 16) == []
    assert largest_roots(poly(7), 16)[0][0] - 7 < Fraction(1, 10**40)


def test_sums_are_exact_for_large_numbers(llm_spark):
    rng = np.random.default_rng(2)
    y = rng.integers(-(1 << 61), 1 << 61, (50, 3))
    want = y.astype(object).T @ y.astype(object)
    assert (products(y) == want).all()
    rows = llm_spark.createDataFrame([(i, [int(v) for v in r + whitening.SHIFT]) for i, r in enumerate(y)], "vec_id long, x array<long>")
    n, sums, pairs = moments(rows.repartition(4))
    assert (n, sums) == (50, list(y.astype(object).sum(axis=0))) and (pairs == want).all()


def test_deviation_beyond_a_long(llm_spark):
    rows = [(0, [3e9, 0.0]), (1, [-3e9, 1.0]), (2, [0.0, 5.0])]
    got = {r["vec_id"]: r["deviation"] for r in whiten(frame(llm_spark, rows)).collect()}
    x = {i: [int(np.floor(64 * c)) for c in v] for i, v in rows}
    sums = [sum(v[k] for v in x.values()) for k in (0, 1)]
    assert got == {i: Decimal(sum((3 * v[k] - sums[k]) ** 2 for k in (0, 1))) for i, v in x.items()}


def test_floor_of_negative_entries(llm_spark):
    got = whole(frame(llm_spark, [(1, [-0.01, 0.99, -0.0, 1 / 64])])).first()["x"]
    assert got == [999_999, 1_000_063, 1_000_000, 1_000_001]
