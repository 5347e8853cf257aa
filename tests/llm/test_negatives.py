import numpy as np
import pytest
from pyspark.sql import functions as F

from marklens.llm import negatives
from marklens.llm.vectors import finite, whole_numbers

SCHEMA = "vec_id long, label int, x array<bigint>, _block int, anchor string"


def _brute(rows, positives=5, negatives_=10, low=30, high=90, every=100):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a in (r for r in rows if r[0] % every == 0):
        other = [(-dot(a[2], b[2]), b[0], b[1]) for b in rows]
        near = sorted((s, i) for s, i, label in other if label == a[1] and i != a[0])[:positives]
        for s, i in near:
            p = -s
            ok = sorted((t, j) for t, j, label in other if label != a[1] and low * p <= -100 * t <= high * p)[:negatives_]
            out += [(a[0], i, k + 1, j, p, -t) for k, (t, j) in enumerate(ok)]
    return sorted(out)


def _mine(spark, rows, parts=4, every=100):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, "vec_id").collect())


@pytest.mark.parametrize("size", [3, 400])
def test_against_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(negatives, "SCORES", 50)
    monkeypatch.setattr(negatives, "GATHER", 40)
    monkeypatch.setattr(negatives, "CHUNK", 4)
    rng = np.random.default_rng(7)
    rows = [(int(i) - 200, int(rng.integers(0, 3)), rng.integers(-4, 5, size=int(rng.choice([4, 5]))).tolist()) for i in rng.permutation(size)]
    want = _brute(rows, every=10)
    assert _mine(spark, rows, every=10) == want
    monkeypatch.setattr(negatives, "BLOCK", 7)  # several blocks of anchors
    assert _mine(spark, rows, every=10) == want


def test_ties_repeats_nulls_and_one_label(spark):
    same = [2] * 4
    rows = [(100, 1, same)] * 2 + [(k, 1, same) for k in range(5)] + [(k, 2, [1, 1, 1, 1]) for k in range(20, 50)] + [(20, 2, [1, 1, 1, 1])] * 3
    rows += [(None, 1, same), (60, None, same), (61, 2, None), (200, 7, same), (300, 1, [0, 0, 0, 0]), (400, 1, []), (500, 1, [-1, 0, 0, 0])]
    assert _mine(spark, rows) == _brute(rows)


def test_one_label_on_a_third_of_the_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0 if i % 3 == 0 else i % 50, rng.integers(-9, 10, 8).tolist()) for i in range(600)]
    assert _mine(spark, rows) == _brute(rows)


def test_large_entries_stay_exact_and_too_large_ones_are_refused(spark):
    big = 2**27 + 1
    rows = [(0, 1, [big, 1]), (1, 1, [big, 0]), (2, 1, [big, 2]), *[(10 + k, 2, [big // 2, k]) for k in range(20)]]
    assert _mine(spark, rows) == _brute(rows)
    with pytest.raises(ValueError, match="long"):
        _mine(spark, [(0, 1, [2**40]), (1, 1, [2**40])])


def test_empty(spark):
    assert _mine(spark, []) == []
    assert _mine(spark, [(1, 1, [1]), (2, 2, [1])]) == []
    assert _mine(spark, [(100, 1, [1])]) == []


def test_vectors_that_take_no_part(spark):
    rows = [(1, [0.5, -0.001]), (2, [None, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, []), (7, [-0.0, 1e300])]
    df = spark.createDataFrame(rows, "id long, v array<double>").where(finite("v")).select("id", whole_numbers("v").alias("x"))
    assert sorted((r.id, r.x) for r in df.collect()) == [(1, [128, -1]), (6, []), (7, [0, 2**63 - 1])]
