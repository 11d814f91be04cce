"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Entries become whole numbers, x = floor(64 * c) + 1000000. The fit takes each distinct vector once. Its sums,
and then the products of entries centred on the rounded means, are added up by tasks in exact integers, so that
the covariance (divisor: number of vectors) is the exact one rounded once, whatever the order of the rows. Only
that matrix, of the dimension's size, reaches the driver, where it is factored as V = A A', A lower triangular
but for the order of its rows; rotations of pairs of columns of A make these orthogonal, their squared norms are
the eigenvalues and the normalised columns the components (the entry of the largest size is positive).

Defined results: rows go whose vector is null, holds null or non-finite entries, or has another length than most
(of lengths as frequent, the greatest counts); repeated rows stay, and count once in the fit; components whose
variance is zero to double precision are left out, so a single distinct vector gives no row, as does an empty
table; entries beyond 2^46 / 64 count as that; a deviation beyond 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, fresh, in_arrow, kept

OFFSET, SCALE = 1_000_000, 64
MOST = 1 << 46  # of a scaled entry
COMPONENTS = 16
SWEEPS = 60
_EPS = float(np.finfo(float).eps)
_WHOLE = pa.decimal128(38, 0)


def lattice(vector: Column) -> Column:
    """The vector's entries as whole numbers."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))) + OFFSET)


def vectors(table: DataFrame, vector: str, keep: list[str]) -> tuple[DataFrame, str, int]:
    """The columns ``keep`` and the whole-number vector of each row that counts; the vector's column; the dimension."""
    x, ok = fresh(keep, "x", "sound")
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = table.select(*[F.col(f"`{c}`") for c in keep], v.alias(x), F.coalesce(sound, F.lit(False)).alias(ok)).where(F.col(ok))
    top = own.groupBy(F.size(x).alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).limit(1).collect()
    d = top[0]["d"] if top else 0
    return own.where(F.size(x) == d).select(*[F.col(f"`{c}`") for c in keep], lattice(F.col(x)).alias(x)), x, d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _added(rows: DataFrame, run, of: str) -> dict[int, int]:
    """Exact sums by cell of what each task has added up: a row for each cell reaches the driver."""

    def emit(batches):
        total = None
        for b in batches:
            part = run(b)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([Decimal(int(v)) for v in total], _WHOLE)], ["cell", "v"])

    out = in_arrow(rows.select(of), emit, "cell int, v decimal(38,0)").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    return {r["cell"]: int(r["v"]) for r in out}


def products(y: np.ndarray) -> np.ndarray:
    """y' y in exact integers (objects)."""
    d = y.shape[1]
    if not len(y):
        return np.zeros((d, d), object)
    if int(np.abs(y).max()) < 1 << 21:  # then 1024 rows' sums are exact as doubles
        z, out = y.astype(float), np.zeros((d, d), np.int64)
        for a in range(0, len(z), 1024):
            out += (z[a : a + 1024].T @ z[a : a + 1024]).astype(np.int64)
        return out.astype(object)
    z = y.astype(object)
    return z.T @ z


def covariance(fit: DataFrame, x: str, d: int) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, their sums by dimension, and the covariance matrix."""

    def sums(b: pa.RecordBatch) -> np.ndarray:
        v = _matrix(b.column(0), d)
        return np.r_[v.sum(axis=0).astype(object), len(v)]

    added = _added(fit, sums, x)
    n = added.get(d, 0)
    total = [added.get(k, 0) for k in range(d)]
    if not n:
        return 0, total, np.zeros((d, d))
    middle = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    upper = np.triu_indices(d)

    cells = _added(fit, lambda b: products(_matrix(b.column(0), d) - middle)[upper], x)
    off = [s - n * int(m) for s, m in zip(total, middle, strict=True)]
    v = np.zeros((d, d))
    for k, (i, j) in enumerate(zip(upper[0].tolist(), upper[1].tolist(), strict=True)):
        v[i, j] = v[j, i] = (n * cells[k] - off[i] * off[j]) / (n * n)  # of Python's whole numbers: rounded once
    return n, total, v


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """a with a a' = v, a column for each pivot; the pivot is the largest variance left, none once that is rounding."""
    d = len(v)
    left, a, done = np.diag(v).astype(float).copy(), np.zeros((d, d)), np.zeros(d, bool)
    least = d * _EPS * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        p = int(np.argmax(np.where(done, -1.0, left)))
        if done[p] or left[p] <= least:
            return a[:, :k]
        column = (v[:, p] - a[:, :k] @ a[p, :k]) / np.sqrt(left[p])
        column[done] = 0
        column[p] = np.sqrt(left[p])
        a[:, k] = column
        done[p] = True
        left = left - column * column
    return a


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a a', falling, and the components as columns. All pairs of a round turn at once."""
    a, r = a.copy(), a.shape[1]
    seats = np.arange(r + r % 2)
    for _ in range(SWEEPS if r > 1 else 0):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = seats[:half], seats[half:][::-1]
            there = (p < r) & (q < r)
            p, q = p[there], q[there]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(xy) > 4 * _EPS * np.sqrt(xx * yy)
            if turn.any():
                turned = True
                p, q, x, y = p[turn], q[turn], x[:, turn], y[:, turn]
                z = (yy[turn] - xx[turn]) / (2 * xy[turn])
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
            seats = np.r_[seats[0], seats[-1], seats[1:-1]]  # everyone meets everyone
        if not turned:
            break
    e = (a * a).sum(axis=0)
    order = np.argsort(-e, kind="stable")
    e, u = e[order], a[:, order] / np.sqrt(e[order])
    return e, u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0) if u.size else u


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvalues of ``v``, at most ``most``, and the unit eigenvectors as columns."""
    e, u = jacobi(pivoted_cholesky(v))
    there = int((e > len(v) * _EPS * e.max(initial=0.0)).sum())
    return e[: min(most, there)], u[:, : min(most, there)]


def _whitener(n: int, total: list[int], e: np.ndarray, u: np.ndarray):
    """Of whole-number vectors: exact n * x - S where it fits, and the whitened projections."""
    middle = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    off = [s - n * int(m) for s, m in zip(total, middle, strict=True)]
    shift, basis = np.array([o / n for o in off]), u / np.sqrt(e)

    def apply(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x - middle
        return y, (y - shift) @ basis

    def deviations(y: np.ndarray) -> list[int | None]:
        far = int(np.abs(y).max(initial=0)) * n + max(map(abs, off), default=0)
        if far * far * len(off) < 1 << 63:
            z = y * n - np.array(off, np.int64)
            return (z * z).sum(axis=1).tolist()
        z = y.astype(object) * n - np.array(off, object)
        return [s if s < 1 << 63 else None for s in (z * z).sum(axis=1).tolist()]

    return apply, deviations


def whitened(table: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), most: int = COMPONENTS) -> DataFrame:
    """The columns ``keep`` with component, n, deviation, whitened, explained and identity_error.

    deviation: sum over dimensions of (n * x - S)^2; identity_error: largest absolute entry of the covariance of
    the whitened fit list less the identity.
    """
    keep = list(keep)
    own, x, d = vectors(table, vector, keep)
    kinds = dict(table.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = kept(own.select(x).distinct(), "vectors") if d else None
    n, total, v = covariance(fit, x, d) if d else (0, [], np.zeros((0, 0)))
    e, u = components(v, most)
    if not len(e):
        if fit is not None:
            forget(fit)
        return in_arrow(own.select(*[F.col(f"`{c}`") for c in keep]).where("false"), lambda batches: iter(()), schema)
    apply, deviations = _whitener(n, total, e, u)
    k = len(e)

    def spread(batches):
        total, cells = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = apply(_matrix(b.column(0), d))[1]
            total, cells = total + w.sum(axis=0), cells + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k), pa.int32()), pa.array(np.r_[total, cells.ravel()])], ["cell", "v"])

    added = in_arrow(fit, spread, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(k + k * k)
    for r in added:
        sums[r["cell"]] = r["v"] / n
    error = float(np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k)).max())
    forget(fit)
    explained = e / np.trace(v)

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                y, w = apply(_matrix(part.column(len(keep)), d))
                m = len(y)
                again = pa.array(np.repeat(np.arange(m), k))
                columns = [part.column(c).take(again) for c in range(len(keep))]
                columns += [pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), pa.array(deviations(y), pa.int64()).take(again)]
                columns += [pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return in_arrow(own, rows, schema)
