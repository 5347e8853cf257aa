"""Hand-made frames with written-out results."""

import pytest
from pyspark.sql import functions as F

from marklens.functions import metrics as M
from marklens.functions import scalars as S
from marklens.operators import agreement as A
from marklens.operators import chance as X
from marklens.operators import contracts as K
from marklens.operators import evaluation as E
from marklens.operators import joins as J
from marklens.operators import order as O
from marklens.operators import queues as Q
from marklens.operators import splits as P

c = F.col


def one(df):
    return df.first().asDict()


def test_half_up_and_kappa(spark):
    p = [0.0, 1.24, 1.25, 1.74, 1.75, 4.74, 4.75, 5.8]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    got = [r[0] for r in df.select(S.half_up(c("p"))).collect()]
    assert got == [1, 1, 1.5, 1.5, 2, 4.5, 5, 5]
    grid = spark.createDataFrame([(1.0,), (2.5,), (5.0,)], "y double")
    assert grid.agg(M.score_kappa(c("y"), c("y"))).first()[0] == 1.0


def test_queue_metrics(spark):
    rows = list(zip([True, False, True, False, False], [True, True, False, False, False]))
    m = one(Q.queue_metrics(spark.createDataFrame(rows, "large boolean, selected boolean"), []))
    assert (m["captured"], m["capture_rate"], m["precision"], m["lift"]) == (1, 0.5, 0.5, 1.25)
    none = one(Q.queue_metrics(spark.createDataFrame([(False, True)], "large boolean, selected boolean"), []))
    assert none["capture_rate"] is None and none["lift"] is None and none["precision"] == 0


def test_string_ties_and_exact_threshold(spark):
    df = spark.createDataFrame([("2", 0.5), ("10", 0.5), ("3", 0.9)], "item_id string, s double")
    order = [r["item_id"] for r in O.rank_rows(df, [F.desc("s"), "item_id"]).orderBy("rank").collect()]
    assert order == ["3", "10", "2"]
    assert spark.range(1).select(S.error_trigger(F.lit(1.0), F.lit(0.99))).first()[0] == "V"


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.5, 3.0, 3.5, 4.0, 5.0, 3.75)], "y double")
    assert [r[0] for r in df.select(S.score_band(c("y"))).collect()] == ["low", "low", "middle", "middle", "high", "high", "invalid"]


def test_raters(spark):
    same = spark.createDataFrame([(1, 1), (3, 3), (5, 5)], "r1 int, r2 int")
    m = one(A.pair_agreement(same, []))
    assert m["qwk"] == 1 and m["icc"] == pytest.approx(1)
    shifted = one(A.pair_agreement(spark.createDataFrame([(1, 2), (3, 4), (4, 5)], "r1 int, r2 int"), []))
    assert shifted["icc"] < 1 and shifted["mae"] == 1


def test_evidence_class(spark):
    f = lambda *v: spark.range(1).select(S.evidence_class(*[F.lit(x) for x in v])).first()[0][0]
    assert [f(0.3, 0.2, 0.1, 0.25), f(0.05, 0.2, 0.1, 0.25), f(0.22, 0.2, 0.1, 0.25), f(0.15, 0.2, 0.1, 0.25)] == ["A", "C", "B", "D"]


def test_point_predictor_tie(spark):
    rows = [("V", "linear", 0.4), ("V", "forest", 0.4 - 5e-13), ("G", "linear", 0.4), ("G", "forest", 0.3)]
    got = {r["target"]: r["selected_model"] for r in E.point_predictors(spark.createDataFrame(rows, "target string, model string, mae double"), "linear", "forest").collect()}
    assert got == {"V": "linear", "G": "forest"}


def test_hypergeometric_goldens(spark):
    df = spark.createDataFrame([("a", 2518, 208, 504, 55), ("b", 2518, 208, 504, 47)], "s string, n long, positives long, k long, caught long")
    p = {r["s"]: r["tail_p"] for r in X.hypergeometric_tail(df, "n", "positives", "k", "caught").collect()}
    assert p["a"] == pytest.approx(0.0115857068, abs=1e-9) and p["b"] == pytest.approx(0.188, abs=5e-4)


def test_pooled_tail_goldens(spark):
    law = [(154, 73, 769), (154, 88, 768), (153, 75, 761), (149, 76, 745), (154, 74, 769)]
    for caught, want in ((96, 0.0085360709), (88, 0.0883568422)):
        rows = [("x", k, pos, n, caught if i == 0 else 0) for i, (k, pos, n) in enumerate(law)]
        got = one(X.pooled_tail(spark.createDataFrame(rows, "signal string, k long, positives long, n long, caught long"), ["signal"]))
        assert got["tail_p"] == pytest.approx(want, abs=1e-9) and got["expected"] == pytest.approx(77.3629084, abs=1e-6)


def test_large_population_tail_is_cheap(spark):
    df = spark.createDataFrame([(10**9, 3 * 10**8, 2 * 10**8, 60_000_000)], "n long, positives long, k long, caught long")
    assert 0.4 < one(X.hypergeometric_tail(df, "n", "positives", "k", "caught"))["tail_p"] < 0.6


def test_contracts_reject(spark):
    good = spark.createDataFrame([("a", " x ", 3), ("b", "y", 4)], "id string, text string, v int")
    out = K.validate_items(good, "id", "text", ["v"])
    assert [r["text"] for r in out.orderBy("id").collect()] == ["x", "y"] and dict(out.dtypes)["v"] == "double"
    for bad in ([("a", "x", 3), ("a", "y", 4)], [("a", "  ", 3)], [("a", "x", None)], [(None, "x", 1)], []):
        with pytest.raises(K.ContractError):
            K.validate_items(spark.createDataFrame(bad, "id string, text string, v int"), "id", "text", ["v"])
    with pytest.raises(K.ContractError):
        K.validate_items(good.drop("v"), "id", "text", ["v"])
    with pytest.raises(K.ContractError):
        K.require_splits(spark.createDataFrame([("official_test",)], "split string"), ["validation"])


def test_one_to_one_rejects(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double")
    for rows in ([(1, 1.0)], [(1, 1.0), (2, 2.0), (2, 3.0)], [(1, float("nan")), (2, 1.0)]):
        with pytest.raises(K.ContractError):
            J.one_to_one(a, spark.createDataFrame(rows, "k int, y double"), "k", ["y"])


def test_equal_texts_share_a_split(spark):
    rows = [(i, f"text {i % 7}", f"p{i % 3}") for i in range(60)] + [(100 + i, "hot", "p0") for i in range(40)]
    out = P.assign(spark.createDataFrame(rows, "id int, text string, prompt string"), S.text_hash(c("text")), "prompt", 0.2, 5, 1)
    per = out.groupBy("content_hash").agg(F.count_distinct("split").alias("s"), F.count_distinct("cv_fold").alias("f"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["s"] == 1 and r["f"] <= 1 for r in per) and sum(r["n"] for r in per) == 100
    again = P.assign(spark.createDataFrame(rows, "id int, text string, prompt string").repartition(5), S.text_hash(c("text")), "prompt", 0.2, 5, 1)
    assert {tuple(r) for r in out.select("id", "split", "cv_fold").collect()} == {tuple(r) for r in again.select("id", "split", "cv_fold").collect()}


def test_count_from_rate(spark):
    df = spark.createDataFrame([(100 * 7 / 311, 311), (0.0, 50), (33.333, 90)], "r double, w int")
    assert [r[0] for r in df.select(S.count_from_rate(c("r"), c("w"))).collect()] == [7, 0, None]


def test_twelve_digits_as_c_writes_them(spark):
    from marklens.sources.tables import twelve_digits

    values = [10 / 3, 1234.56789012345, 123456789.12345679, 0.012345678901234, 1e-5, 9.9999999999999e-5, 1e12, 999999999999.9, 123456789012345.0, -0.1, 0.0, -2.5, 2.3e-308, 1.7e308, 100.0, 1e-4]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = [r[0] for r in df.select(twelve_digits("v")).collect()]
    assert got == ["%.12g" % v for v in values] + [None]


def test_interval_beyond_the_table(spark):
    from marklens.operators.evaluation import fold_interval

    rows = [(f, float(k % 5)) for f in (31, 32, 41, 101) for k in range(f)]
    out = {r.g: r for r in fold_interval(spark.createDataFrame(rows, "g int, mae double"), ["g"]).collect()}
    sd = spark.createDataFrame(rows, "g int, mae double").groupBy("g").agg({"mae": "stddev_samp"}).collect()
    # published two-sided 95% quantiles for 30, 31, 40 and 100 degrees of freedom
    for g, t in ((31, 2.042272456), (32, 2.039513446), (41, 2.021075390), (101, 1.983971519)):
        s = dict(map(tuple, sd))[g]
        assert abs((out[g].high - out[g].mean) / (s / g**0.5) - t) < 1e-6
