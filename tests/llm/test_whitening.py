import numpy as np
import pytest

from marklens.llm import whitening


def _brute(rows, k=4):
    dim = max([1, *[len(x) for _, x in rows if x is not None]])
    pad = [(i, [*x, *[0] * (dim - len(x))]) for i, x in rows if x is not None]
    fit = np.array(sorted({tuple(x) for _, x in pad}), np.int64).reshape(-1, dim)
    n, sums = len(fit), fit.sum(0)
    y = fit - sums / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:k]
    e, u = e[order], u[:, order]
    return pad, n, sums, e, u, np.trace(v)


def _check(spark, rows, parts=3):
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "id long, x array<bigint>, n int, component int").repartition(parts)
    got = whitening.whiten(df).toPandas()
    pad, n, sums, e, u, trace = _brute(rows)
    k = int((e > 1e-9 * max(e[0], 1e-300)).sum()) if n > 1 else 0
    assert len(got) == len(pad) * k
    if not k:
        return
    assert (got.n == n).all() and (got.identity_error < 1e-9).all()
    assert np.allclose(sorted(got.explained.unique())[::-1][:k], e[:k] / trace, rtol=1e-10) or len(got.explained.unique()) < k
    want = {}
    for i, x in pad:
        z = (np.array(x) - sums / n) @ u[:, :k] / np.sqrt(e[:k])
        want.setdefault(i, []).append((sum((n * a - int(s)) ** 2 for a, s in zip(x, sums)), np.abs(z)))
    for i, group in got.groupby("id", dropna=False):
        i = None if i != i else int(i)
        assert sorted(group.deviation.unique()) == sorted({d for d, _ in want[i]})
        for c, one in group.groupby("component"):
            if np.abs(e[c - 1] - np.delete(np.r_[e, 0], c - 1)).min() > 1e-6 * e[0]:
                assert np.allclose(sorted(one.whitened.abs()), sorted(z[c - 1] for _, z in want[i]), atol=1e-8)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 12)) * np.array([90, 40, 20, 9, 4, 2])[:, None]
    x = np.floor(rng.normal(size=(300, 6)) @ base).astype(int).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(1000 + i, x[0]) for i in range(150)] + [(None, x[1]), (2, x[3])]
    _check(spark, rows)


def test_far_from_the_origin(spark):
    rng = np.random.default_rng(6)
    _check(spark, [(i, (10**6 + rng.integers(-3, 4, 5) * np.array([1, 2, 3, 4, 5])).tolist()) for i in range(200)])


def test_low_rank_short_vectors_and_nulls(spark):
    _check(spark, [(1, [1, 2, 3]), (2, [2, 4, 6]), (3, [3, 6]), (4, []), (5, None)])
    _check(spark, [(1, [1, 0]), (2, [5, 0]), (3, [7, 0])])


def test_no_variance(spark):
    for rows in ([], [(1, [1, 2])], [(1, [3]), (2, [3])], [(1, [])], [(1, None)]):
        df = spark.createDataFrame(rows, "id long, x array<bigint>")
        assert whitening.whiten(df).collect() == []


def test_deviation_beyond_a_long():
    x = np.array([[2**40], [1]])
    assert whitening.deviations(x, 2, x.sum(0)) == [None, None]
    assert whitening.deviations(np.array([[2**30], [0]]), 2, np.array([2**30])) == [2**60, 2**60]


@pytest.mark.parametrize("dim, rank", [(1, 1), (2, 2), (7, 3), (64, 64), (65, 10)])
def test_factor_and_rotations(dim, rank):
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(dim, rank)) * np.logspace(0, -4, rank)
    v = a @ a.T
    factor = whitening.pivoted_cholesky(v)
    assert factor.shape == (dim, rank) and np.allclose(factor @ factor.T, v, atol=1e-13)
    e, u = whitening.jacobi(factor)
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-7, atol=1e-14)
    assert np.allclose(u.T @ u, np.eye(rank), atol=1e-12) and np.allclose((u * e) @ u.T, v, atol=1e-13)
