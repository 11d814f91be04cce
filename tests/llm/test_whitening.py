"""Whitening against exact arithmetic and a library's eigenvectors."""

from fractions import Fraction

import numpy as np
import pytest

from corpuswarden.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, component int"


def plain(rows):
    """n, S, V, lattice rows of the vectors that count."""
    sound = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v]) for i, v in sound]
    fit = sorted({tuple(v) for _, v in x})
    n, d = len(fit), len(fit[0])
    total = [sum(v[k] for v in fit) for k in range(d)]
    v = np.array([[float(Fraction(sum((n * a[i] - total[i]) * (n * a[j] - total[j]) for a in fit), n**3)) for j in range(d)] for i in range(d)])
    return x, n, total, v


def test_equal_to_exact_arithmetic(spark):
    rng = np.random.default_rng(3)
    turn = rng.normal(size=(20, 20))
    rows = [(k, (rng.normal(size=20) * np.geomspace(3, 0.05, 20) @ turn).tolist()) for k in range(300)]
    rows += [(900, rows[5][1]), (5, rows[5][1]), (None, rows[7][1]), (901, None), (902, [1.0] * 19 + [None]), (903, [1.0] * 19 + [float("nan")]), (904, [float("inf")] * 20), (905, []), (906, [1.0] * 7)]
    got = whitening.whitened(spark.createDataFrame([(i, v, "own", 7) for i, v in rows], SCHEMA).repartition(3)).collect()
    x, n, total, v = plain([r for r in rows if r[0] not in (905, 906)])
    assert len(got) == 16 * 303 and {r.vec_id for r in got} == set(range(300)) | {900, None}
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    by = {(r.vec_id, r.component): r for r in got}
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    for c in range(1, 17):
        w = [(float(sum(Fraction(n * a - s, n) * Fraction(float(q)) for a, s, q in zip(p, total, u[:, c - 1], strict=True))) / np.sqrt(e[c - 1]), by[i, c]) for i, p in x if i is not None]
        mine, theirs = np.array([r.whitened for _, r in w]), np.array([t for t, _ in w])
        assert np.abs(mine - np.sign(mine @ theirs) * theirs).max() < 1e-7
        assert {r.explained for _, r in w} == {w[0][1].explained} and w[0][1].explained == pytest.approx(e[c - 1] / np.trace(v), rel=1e-9)
    for i, p in x:
        if i is not None:
            assert by[i, 1].deviation == sum((n * a - s) ** 2 for a, s in zip(p, total, strict=True))


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (6, 6), (9, 4), (33, 33)):
        b = rng.normal(size=(d, rank)) * np.geomspace(1, 1e-3, rank)
        v = b @ b.T
        a = whitening.pivoted_cholesky(v)
        assert a.shape == (d, rank) and np.allclose(a @ a.T, v, atol=1e-14 * np.trace(v))
        order = [int(np.flatnonzero(a[:, k])[np.argmin([np.abs(a[r, k + 1 :]).sum() for r in np.flatnonzero(a[:, k])])]) for k in range(rank)]
        assert np.allclose(np.triu(a[order], 1), 0)  # lower triangular in the order of the pivots
        e, u = whitening.jacobi(a)
        assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-9)
        assert np.allclose(u.T @ u, np.eye(rank), atol=1e-12) and np.allclose(v @ u, u * e, atol=1e-13 * np.trace(v))


def test_few_and_large_vectors(spark):
    table = lambda rows: spark.createDataFrame([(i, v, "own", 7) for i, v in rows], SCHEMA)
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, []), (2, [])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        got = whitening.whitened(table(rows))
        assert got.columns == columns and got.count() == 0
    got = whitening.whitened(table([(1, [0.0, 0.0, 3.0]), (2, [1.0, 1.0, 3.0]), (3, [2.0, 2.0, 3.0])])).collect()
    assert [(r.vec_id, r.component) for r in sorted(got, key=lambda r: r.vec_id)] == [(1, 1), (2, 1), (3, 1)]  # rank 1
    assert sorted(round(abs(r.whitened), 9) for r in got) == [0, round(1.5**0.5, 9), round(1.5**0.5, 9)]
    got = whitening.whitened(table([(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 9.0])])).collect()
    assert {r.deviation for r in got} == {None} and len(got) == 3 and all(np.isfinite(r.whitened) for r in got)


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for top in (50, 1 << 20, 1 << 40):
        y = rng.integers(-top, top, size=(2500, 3))
        got = whitening.products(y)
        assert all(got[i, j] == sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for i in range(3) for j in range(3))
