import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marklens.functions import draws as D
from marklens.operators import bootstrap as B
from marklens.operators import chance as X
from marklens.operators import queues as Q


def _weights(items, reps, seed, columns):
    """Weights of items, cells by cells, for brute force: (cells frame with m and key, weights)."""
    got = items.groupby(columns, dropna=False).agg(m=("item_no", "size"), key=("item_no", "min")).reset_index()
    return got, D.poisson_weights(got.key.to_numpy(), got.m.to_numpy(), np.arange(reps + 1), seed)


def _auroc(score, large, w):
    s, y = np.repeat(score, w.astype(int)), np.repeat(large, w.astype(int))
    if y.all() or not y.any():
        return None
    pos, neg = s[y], s[~y]
    return ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def items():
    rng = np.random.default_rng(1)
    n = 900
    score = np.where(rng.random(n) < 0.35, 0.25, rng.integers(0, 40, n) / 8)  # a third of all items on one value
    return pd.DataFrame({"item_no": np.arange(n), "item_id": [str(i) for i in range(n)], "score": score, "other": rng.integers(0, 300, n) / 4, "large": rng.random(n) < 0.2, "fold": rng.integers(0, 3, n)})


def test_hash_is_uniform_and_independent():
    u = D.uniform(np.arange(2000)[:, None], np.arange(1, 1001)[None, :], 7)
    assert abs(u.mean() - 0.5) < 1e-3 and abs(u.var() * 12 - 1) < 5e-3
    for a, b in ((u[:-1], u[1:]), (u[:, :-1], u[:, 1:]), (u[:-1, :-1], u[1:, 1:])):
        assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 5e-3
    assert np.unique(u).size > 0.99 * u.size


@pytest.mark.parametrize("m", [1, 4, 1000])
def test_cell_weights_follow_poisson(m):
    w = D.poisson_weights(np.arange(500), np.full(500, m), np.arange(1, 1001), 3)
    assert abs(w.mean() / m - 1) < 0.01 and abs(w.var() / m - 1) < 0.02
    assert (D.poisson_weights(np.arange(5), np.arange(1, 6), np.array([0]), 3)[:, 0] == np.arange(1, 6)).all()


@pytest.mark.parametrize("n, positives, k", [(30, 7, 12), (5000, 400, 1000), (12, 12, 5), (12, 0, 5), (9, 4, 0), (9, 4, 9), (1, 1, 1)])
def test_hypergeometric_law_and_draws(n, positives, k):
    lo, p = D.hypergeometric_law(n, positives, k)
    x = np.arange(lo, lo + len(p))
    want = np.array([math.comb(positives, i) * math.comb(n - positives, k - i) / math.comb(n, k) for i in x.tolist()])
    assert np.allclose(p, want, rtol=1e-10, atol=1e-18) and abs(p.sum() - 1) < 1e-12
    u = np.linspace(0.0005, 0.9995, 1000)
    got = D.hypergeometric_draws(np.full(1000, n), np.full(1000, positives), np.full(1000, k), u)
    assert (got == lo + np.searchsorted(np.cumsum(p) - p, u, "right") - 1).all()


def test_laws_of_a_billion_items_stay_small():
    lo, p = D.hypergeometric_law(10**9, 10**8, 2 * 10**8)
    assert len(p) < 100_000 and abs(p.sum() - 1) < 1e-12
    start, law = X.pooled_law([(2 * 10**8, 2 * 10**7, 4 * 10**7)] * 5)
    assert abs(law.sum() - 1) < 1e-12
    mean = (np.arange(start, start + len(law)) * law).sum()
    assert abs(mean - 2 * 10**7) < 1e-3


def test_pooled_law_equals_enumeration():
    start, law = X.pooled_law([(10, 3, 4), (8, 2, 3), (5, 5, 2)])
    want = {}
    for a in range(4):
        for b in range(3):
            p = math.comb(3, a) * math.comb(7, 4 - a) / math.comb(10, 4) * math.comb(2, b) * math.comb(6, 3 - b) / math.comb(8, 3)
            want[a + b + 2] = want.get(a + b + 2, 0) + p
    assert np.allclose(law, [want[start + i] for i in range(len(law))])


def test_random_captures(spark, items):
    df = spark.createDataFrame(items)
    got = X.random_captures(X.queue_counts(df, 0.2, ["fold"]), 2000, 5).toPandas()
    assert len(got) == 6000
    for _, one in got.groupby("fold"):
        n, positives, k = one.n.iloc[0], one.positives.iloc[0], one.k.iloc[0]
        assert k == math.ceil(0.2 * n) and one.captured.between(0, min(k, positives)).all()
        sd = math.sqrt(k * positives / n * (1 - positives / n) * (n - k) / (n - 1))
        assert abs(one.captured.mean() - k * positives / n) < 4 * sd / math.sqrt(2000) and abs(one.captured.std() / sd - 1) < 0.08


def test_random_draws_move_no_items(spark, items):
    plan = X.random_captures(X.queue_counts(spark.createDataFrame(items), 0.2), 1000, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the counts' own


def test_subgroups_share_the_queue(spark, items):
    df = spark.createDataFrame(items.assign(group=np.where(items.item_no < 12, "tiny", np.where(items.fold == 1, None, "b")), selected=items.item_no % 5 == 0))
    got = Q.subgroup_random_capture(df, ["fold", "group"], 500, 0.2, 9).toPandas()
    tiny = got[got.grp == "tiny"].iloc[0]
    assert not tiny.reported and tiny.n == 12 and math.isnan(tiny.random_mean_caught) and tiny.note is None
    folds = got[got.attribute == "fold"]
    assert abs(folds.random_mean_selected.sum() - 180) < 1e-9  # every draw holds the whole queue
    assert (abs(folds.random_mean_rate - 0.2) < 0.01).all() and (abs(folds.random_mean_capture - 0.2) < 0.02).all()
    assert (folds.caught == items[items.large & (items.item_no % 5 == 0)].groupby("fold").size().to_numpy()[folds.grp.astype(int)]).all()


@pytest.mark.parametrize("segments", [1, 7, 40])
def test_auroc_per_replicate(spark, items, segments):
    columns = ["large", "score", "other"]
    cells, w = _weights(items, 20, 5, columns)
    found = B.cells(spark.createDataFrame(items), {c: F.col(c) for c in columns})
    got = B.replicate_auroc(B.signals_of(found, {"score": F.col("score"), "other": -F.col("other")}), ["signal"], 20, 5, segments).toPandas()
    for r in got.itertuples():
        s = cells.score.to_numpy() if r.signal == "score" else -cells.other.to_numpy()
        assert r.auroc == pytest.approx(_auroc(s, cells.large.to_numpy(), w[:, r.rep]), abs=1e-12)
    assert len(got) == 42


def test_auroc_of_one_class_and_null_scores(spark):
    df = spark.createDataFrame([(1, 2.0, True), (2, 3.0, True), (3, None, False)], "item_no long, s double, large boolean")
    got = B.auroc_bootstrap(df, {"s": F.col("s")}, 5, 1).collect()
    assert [r.auroc for r in got] == [None] * 6


def test_hot_score_is_cut_over_segments(spark):
    n = 6000
    df = spark.range(n).select(F.col("id").alias("item_no"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / n).alias("s"), (F.col("id") % 7 == 0).alias("large"))
    found = B.cells(df.withColumn("u", F.col("item_no")), {"large": F.col("large"), "s": F.col("s"), "u": F.col("u")})
    rows = B.signals_of(found, {"s": F.col("s")})
    got = B.replicate_auroc(rows, ["signal"], 4, 2, 12).toPandas().set_index("rep").auroc
    cells = found.toPandas()
    w = D.poisson_weights(cells.key.to_numpy(), cells.m.to_numpy(), np.arange(5), 2)
    for rep in range(5):
        assert got[rep] == pytest.approx(_auroc(cells.s.to_numpy(), cells.large.to_numpy(), w[:, rep]), abs=1e-12)
    sizes = rows.repartitionByRange(12, "signal", "score", "key").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() < 3 * sizes.median()


def _spearman(a, b, w):
    r = [pd.Series(np.repeat(v, w.astype(int))).rank() for v in (a, b)]
    return r[0].corr(r[1])


@pytest.mark.parametrize("limit", [10, 10_000])
def test_spearman_both_ways(spark, items, limit):
    columns = ["score", "other"]
    cells, w = _weights(items, 6, 8, columns)
    got = B.spearman_bootstrap(spark.createDataFrame(items), {"x": (F.col("score"), F.col("other"))}, 6, 8, limit=limit).toPandas()
    assert sorted(got.rep) == list(range(7))
    for r in got.itertuples():
        assert r.spearman == pytest.approx(_spearman(cells.score, cells.other, w[:, r.rep]), abs=1e-9)


@pytest.mark.parametrize("ranks", [0, B.RANKS])
def test_spearman_of_many_cells(spark, items, ranks, monkeypatch):
    """Beyond the limit of cells, columns of few values write no row per cell and replicate; a missing value stays the largest."""
    df = items.assign(other=items.other.where(items.other > 5))
    pairs = {"x": (F.col("score"), F.col("other")), "y": (F.col("item_no") % 50, F.col("other"))}
    data = spark.createDataFrame(df).withColumn("other", F.nanvl("other", F.lit(None).cast("double"))) if ranks else spark.createDataFrame(items)
    want = B.spearman_bootstrap(data, pairs, 150, 8).toPandas().set_index(["pair", "rep"]).spearman
    if ranks:
        monkeypatch.setattr(B, "replicate", None)
    got = B.spearman_bootstrap(data, pairs, 150, 8, limit=10, ranks=ranks).toPandas().set_index(["pair", "rep"]).spearman
    assert len(got) == 302 and np.allclose(got.sort_index(), want.sort_index(), atol=1e-9)


@pytest.mark.parametrize("mean", [1, 2, 64, 65, 400])
def test_counts_by_table_are_those_of_the_law(mean):
    key, reps = np.arange(300), np.arange(1, 200)
    lo, before = D.poisson_law(mean)
    want = lo + np.searchsorted(before, D.uniform(key[:, None], reps[None, :], 9).ravel(), "right") - 1
    assert (D.poisson_weights(key, np.full(300, mean), reps, 9).ravel() == want).all()
    if mean == 1:
        assert (D.poisson_ones(D.key_part(key, 9), 5) == D.poisson_weights(key, np.ones(300, int), np.array([5]), 9)[:, 0]).all()


@pytest.mark.parametrize("limit", [10, 10_000])
def test_agreement_both_ways(spark, items, limit):
    cells, w = _weights(items, 5, 8, ["score", "other"])
    got = B.agreement_bootstrap(spark.createDataFrame(items), "score", "other", 5, 8, limit=limit).toPandas().set_index("rep")
    for rep in range(6):
        a, b = (np.repeat(cells[c], w[:, rep].astype(int)) for c in ("score", "other"))
        want = [a.mean(), b.mean(), abs(a.mean() - b.mean()), b.mean() / a.mean(), np.corrcoef(a, b)[0, 1], _spearman(cells.score, cells.other, w[:, rep]), np.median(a), np.median(b)]
        assert np.allclose(got.loc[rep, list(B.AGREEMENT)].to_numpy(float), want, atol=1e-9)


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(6)], "item_no long, a double, b double")
    got = B.spearman_bootstrap(df, {"p": (F.col("a"), F.col("b"))}, 3, 1).collect()
    assert [r.spearman for r in got] == [None] * 4
    flat = B.slope_bootstrap(df, F.col("b"), F.col("a"), 3, 1).collect()
    assert [r.slope for r in flat] == [None] * 4


def test_queue_differences(spark, items):
    df = items.assign(old=items.score > 2, new=items.other > 60, rate=0.2)
    cells, w = _weights(df, 8, 4, ["fold", "large", "old", "new", "rate", "score", "other"])
    got = B.queue_difference_bootstrap(spark.createDataFrame(df), F.col("score"), F.col("other"), 8, 4, "fold").toPandas()
    assert len(got) == 9 * 4
    for r in got.itertuples():
        use = np.ones(len(cells), bool) if r.scope == "pooled" else (cells.fold == int(r.scope[4:])).to_numpy()
        v, x = cells[use], w[use, r.rep]
        hit = lambda q: float((x * (v.large & v[q])).sum())
        assert r.delta_caught == hit("new") - hit("old") and r.delta_capture == pytest.approx((hit("new") - hit("old")) / (x * v.large).sum())
        assert r.new_excess == pytest.approx(hit("new") - 0.2 * (x * v.large).sum(), abs=1e-9)
        a, b = _auroc(v.score.to_numpy(), v.large.to_numpy(), x), _auroc(v.other.to_numpy(), v.large.to_numpy(), x)
        assert (r.auroc_old, r.auroc_new, r.delta_auroc) == pytest.approx((a, b, b - a), abs=1e-9)


def test_error_correlations(spark, items):
    df = spark.createDataFrame(items).select("item_no", "score", "other", (F.col("score") * 2 + 0.125).alias("copy"))
    got = B.error_correlations(df, {c: F.col(c) for c in ("score", "other", "copy")}, 50, 6).toPandas().set_index(["model_a", "model_b", "method"])
    assert len(got) == 6
    assert got.loc[("score", "other", "pearson"), "estimate"] == pytest.approx(np.corrcoef(items.score, items.other)[0, 1])
    assert got.loc[("score", "other", "spearman"), "estimate"] == pytest.approx(items.score.rank().corr(items.other.rank()))
    same = got.loc[("score", "copy", "spearman")]
    assert same.estimate == pytest.approx(1) and not same.below_limit and not same.interval_below_limit
    far = got.loc[("score", "other", "pearson")]
    assert far.below_limit and far.interval_below_limit and far.low < far.estimate < far.high and far.valid == 50


def test_empty_table(spark):
    df = spark.createDataFrame([], "item_no long, large boolean, a double, b double")
    assert B.auroc_bootstrap(df, {"a": F.col("a")}, 3, 1).collect() == []
    assert B.spearman_bootstrap(df, {"p": (F.col("a"), F.col("b"))}, 3, 1).where("spearman is not null").collect() == []


@pytest.mark.parametrize("over", [0, 300, 40_000])
def test_pooled_tail_sql_at_large_counts(over):
    """Folds of 900,000 items: the twin keeps its digits, and its row where nothing as extreme is likely."""
    from marklens.plans.chance_queries import _conv

    folds = [(900_000, 290_000 + 1000 * f, 180_000, 58_000 + 200 * f + over // 5) for f in range(5)]
    rows = ", ".join(f"({i}, {n}::BIGINT, {pos}::BIGINT, {k}::BIGINT, {x}::BIGINT)" for i, (n, pos, k, x) in enumerate(folds))
    sql = f"WITH fc AS (SELECT * FROM (VALUES {rows}) t(cv_fold, n, positives, k, caught)), {_conv()}, o AS (SELECT sum(caught) AS caught FROM fc) SELECT coalesce(sum(p), 0) FROM o LEFT JOIN c4 ON x >= caught"
    start, law = X.pooled_law([f[:3] for f in folds])
    want = law[max(sum(f[3] for f in folds) - start, 0) :].sum()
    assert abs(duckdb.sql(sql).fetchall()[0][0] - want) < 1e-10
    assert want == 0 if over == 40_000 else want > 1e-3


@pytest.mark.parametrize("near", [8.0, 0.02])
def test_drawn_captures_rank_every_item(spark, items, near):
    """Every queue is drawn item by item; a neighbourhood that is too narrow is widened, not cut."""
    counts = X.queue_counts(spark.createDataFrame(items), 0.2, ["fold"])
    got = X.drawn_captures(spark.createDataFrame(items).repartition(3), counts, 60, 5, ["fold"], near=near).toPandas()
    assert len(got) == 180
    for r in got.itertuples():
        part = items[items.fold == r.fold]
        u = D.uniform(part.item_no.to_numpy(), np.array([r.draw]), 5)
        assert r.n == len(part) and r.captured == part.large.to_numpy()[np.lexsort((part.item_no, u))[: r.k]].sum()


@pytest.mark.parametrize("name", ["k1_random_queues", "k6_joint_draw_tail", "k7_empirical_tail"])
def test_queues_are_drawn_from_items(spark, sf, name):
    """The SQL orders items in every draw, and the query agrees with it."""
    from marklens.plans import registry
    from marklens.plans import catalogue  # noqa: F401  (registers every query)

    con = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert "ORDER BY u, item_no" in registry.TWINS[name]
    cur = con.execute(registry.TWINS[name])
    names = [d[0] for d in cur.description]
    got = registry.QUERIES[name](spark, sf).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())
