"""Whitening of integer vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

The distinct vectors are one written table.  A first pass sums them (exact), a second adds up the products of centred
vectors; both leave the tasks as one row per dimension, or per pair of dimensions, and only these sums of dim x dim
numbers reach the driver.  There the covariance V is factored with full pivoting into a triangular L with V = L L', and
Jacobi rotations are applied to the columns of L until they are orthogonal.  V itself is never rotated: a squared column
norm of the rotated factor is an eigenvalue, the normalised column its unit eigenvector.  Every row is then projected
inside its task.

Odd inputs: the caller leaves out null vectors and those with a null or non-finite entry (``vectors.finite``).  Shorter
vectors count as padded with zeros.  Repeated vectors count once in the fit and each get their rows; a row without id
keeps its null id.  Components beyond the numeric rank are not returned, as their variance is zero: a table of one
distinct vector, or an empty one, gives no row.  A deviation beyond a long is null.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklens.llm.tables import materialise, small_batches
from marklens.llm.vectors import matrix, same_length

_LONG = 2**63 - 1


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L of ``v = L @ L.T``, one row per dimension of v and one column per step; stops at the numeric rank."""
    dim = len(v)
    rest, left = v.astype(np.float64, copy=True), np.diag(v).astype(np.float64).copy()
    stop = dim * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    columns: list[np.ndarray] = []
    done = np.zeros(dim, bool)
    while not done.all():
        p = int(np.argmax(np.where(done, -np.inf, left)))
        if left[p] <= stop:
            break
        column = np.where(done, 0.0, rest[:, p]) / np.sqrt(left[p])
        column[p] = np.sqrt(left[p])
        done[p] = True
        rest -= np.outer(column, column)
        left = np.diag(rest).copy()
        columns.append(column)
    return np.array(columns).T.reshape(dim, len(columns))


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of 0..n-1 in rounds of disjoint pairs."""
    even = n + n % 2
    ring = np.arange(even)
    for _ in range(even - 1):
        a, b = ring[: even // 2], ring[: even // 2 - 1 : -1]
        real = (a < n) & (b < n)
        yield np.minimum(a, b)[real], np.maximum(a, b)[real]
        ring = np.r_[ring[0], ring[-1], ring[1:-1]]


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of ``factor @ factor.T``, from rotations of its columns."""
    rows = np.ascontiguousarray(factor.T)  # one row per column of the factor
    n = len(rows)
    tiny = 4 * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for p, q in _rounds(n):
            x, y = rows[p], rows[q]
            a, b, g = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            far = np.abs(g) > tiny * np.sqrt(a * b)
            if not far.any():
                continue
            turned = True
            p, q, x, y, a, b, g = p[far], q[far], x[far], y[far], a[far], b[far], g[far]
            zeta = (b - a) / (2 * g)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = (1 / np.sqrt(1 + t * t))[:, None]
            s = c * t[:, None]
            rows[p], rows[q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    norms = np.sqrt((rows * rows).sum(1))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    vectors = (rows[order] / norms[order, None]).T
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]) if len(order) else np.ones(0)
    return norms[order] ** 2, vectors * signs


class Fit(NamedTuple):
    n: int  # distinct vectors
    sums: np.ndarray  # per dimension, exact
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors, one column each
    trace: float


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim, np.int64), 0
        for batch in batches:
            x = matrix(batch.column(0), dim)
            total, n = total + x.sum(0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim), pa.int32()), pa.array(np.r_[n, total], pa.int64())], ["i", "s"])

    return run


def _scatter(dim: int, mean: np.ndarray):
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            y = matrix(batch.column(0), dim) - mean
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], ["i", "j", "v"])

    return run


def fit(distinct: DataFrame, dim: int) -> Fit:
    """Covariance of the vectors in the only column of ``distinct`` (divisor n) and its eigenvectors."""
    got = distinct.mapInArrow(_sums(dim), "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    sums = np.zeros(dim + 1, np.int64)
    sums[got.column("i").to_numpy() + 1] = got.column("s").to_numpy()
    n, sums = int(sums[0]), sums[1:]
    if not n:
        return Fit(0, sums, np.zeros(0), np.zeros((dim, 0)), 0.0)
    got = distinct.mapInArrow(_scatter(dim, sums / n), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    v = np.zeros((dim, dim))
    i, j = got.column("i").to_numpy(), got.column("j").to_numpy()
    v[i, j] = v[j, i] = got.column("v").to_numpy() / n
    values, vectors = jacobi(pivoted_cholesky(v))
    return Fit(n, sums, values, vectors, float(np.trace(v)))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of ``(n * x - S)^2``; None beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if most * most * x.shape[1] <= _LONG:
        return ((n * x - sums) ** 2).sum(1).tolist()
    whole = (n * x.astype(object) - sums.astype(object)) ** 2
    return [int(v) if v <= _LONG else None for v in whole.sum(1)]


def _projected(model: Fit, k: int):
    base = model.vectors[:, :k] / np.sqrt(model.values[:k])
    mean = model.sums / model.n

    def project(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ base

    return project


def _whitened_columns(model: Fit, k: int, dim: int):
    project = _projected(model, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = project(matrix(batch.column(0), dim))
            yield pa.RecordBatch.from_arrays([pa.array(z[:, c]) for c in range(k)], [f"z{c}" for c in range(k)])

    return run


def identity_error(distinct: DataFrame, model: Fit, k: int, dim: int) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity; the products are of centred values."""
    z = distinct.mapInArrow(_whitened_columns(model, k, dim), ", ".join(f"z{c} double" for c in range(k)))
    row = z.agg(*[F.covar_pop(f"z{a}", f"z{b}").alias(f"c{a}_{b}") for a in range(k) for b in range(a, k)]).first()
    return max(abs(row[f"c{a}_{b}"] - (a == b)) for a in range(k) for b in range(a, k))


def _rows(model: Fit, k: int, dim: int, error: float):
    project = _projected(model, k)
    share = (model.values[:k] / model.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)
            z, m = project(x), len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)),
                 pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(z.reshape(-1)),
                 pa.array(share * m), pa.array(np.full(m * k, error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(rows: DataFrame, id_col: str = "id", vector_col: str = "x", components: int = 4) -> DataFrame:
    """One row per input row and component: id, component, n, deviation, whitened, explained, identity_error."""
    small_batches(rows.sparkSession)
    own, dim = same_length(rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x")), "x")
    distinct = materialise(own.select("x").distinct(), "distinct")
    model = fit(distinct, dim)
    k = min(components, len(model.values))
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    return own.mapInArrow(_rows(model, k, dim, identity_error(distinct, model, k, dim)), schema)
