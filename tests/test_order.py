"""Order-dependent operators over several segments against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marklens.operators import order as O
from marklens.session import materialise


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 700
    pdf = pd.DataFrame({
        "item_id": [str(i) for i in range(n)],
        # a third of all rows share one group and one score
        "g": np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n)),
        "s": np.where(rng.random(n) < 0.35, 0.5, rng.integers(0, 40, n) / 8.0),
        "y": rng.integers(0, 30, n) / 4.0,
        "w": rng.integers(1, 5, n),
        "large": rng.random(n) < 0.3,
    })
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).repartition(6)


def test_rank_rows_matches_sort(df, frame):
    got = O.rank_rows(df, [F.desc("s"), "item_id"], ["g"], segments=7).toPandas()
    want = frame.sort_values(["s", "item_id"], ascending=[False, True])
    want = want.assign(rank=want.groupby("g").cumcount() + 1, size=want.groupby("g")["s"].transform("size"))
    m = got.merge(want, on="item_id", suffixes=("", "_w"))
    assert len(m) == len(frame)
    assert (m["rank"] == m["rank_w"]).all() and (m["group_n"] == m["size"]).all()


def test_rank_rows_without_groups_and_null_groups(spark):
    rows = [(str(i), None if i % 3 else "x", float(i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "item_id string, g string, s double")
    got = O.rank_rows(df, ["s", "item_id"], segments=5).toPandas()
    assert sorted(got["rank"]) == list(range(1, 61))
    per = O.rank_rows(df, ["s", "item_id"], ["g"], segments=5).toPandas()
    assert len(per) == 60 and sorted(per[per.g.isna()]["rank"]) == list(range(1, 41))


def test_quantiles_match_numpy(df, frame):
    got = O.quantiles(df, "s", {"a": 0.05, "b": 0.5, "c": 0.9}, ["g"], segments=6).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.quantile(part["s"], [0.05, 0.5, 0.9]))


def test_weighted_quantile_is_quantile_of_repeated_rows(df, frame):
    got = O.quantiles(df, "y", {"m": 0.5}, weight="w", segments=4).first()["m"]
    assert got == np.quantile(np.repeat(frame["y"], frame["w"]), 0.5)


def test_average_ranks_and_spearman(df, frame):
    got = O.average_ranks(df, "s", segments=5).toPandas().set_index("s")["avg_rank"]
    want = frame["s"].rank().groupby(frame["s"]).first()
    assert np.allclose(got.sort_index(), want.sort_index())
    rho = O.spearman(df, "s", "y", ["g"], segments=5).toPandas().set_index("g")["spearman"]
    for g, part in frame.groupby("g"):
        assert np.isclose(rho[g], part["s"].rank().corr(part["y"].rank()))


def test_weighted_spearman_equals_repeated_rows(df, frame):
    got = O.spearman(df, "s", "y", weight="w", segments=3).first()["spearman"]
    rep = frame.loc[np.repeat(frame.index, frame["w"])]
    assert np.isclose(got, rep["s"].rank().corr(rep["y"].rank()))


def test_auroc_by_pairs(df, frame):
    got = O.auroc(df, "s", "large", segments=6).first()
    pos, neg = frame[frame.large]["s"].to_numpy(), frame[~frame.large]["s"].to_numpy()
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert np.isclose(got["auroc"], wins / (len(pos) * len(neg)))
    one = O.auroc(df.where("large"), "s", "large").first()
    assert one["auroc"] is None


def test_ks_statistic(df, frame):
    got = O.ks_statistic(df, "y", F.col("large"), segments=4).first()["ks"]
    xs = np.sort(frame["y"].unique())
    a, b = np.sort(frame[frame.large]["y"]), np.sort(frame[~frame.large]["y"])
    want = max(abs(np.searchsorted(a, x, "right") / len(a) - np.searchsorted(b, x, "right") / len(b)) for x in xs)
    assert np.isclose(got, want)


def test_rank_by_key_and_selection(df, frame):
    import hashlib

    keyed = df.withColumn("k", O.seeded_key(7, "item_id"))
    got = O.rank_by_key(keyed, "k", "item_id", ["g"], digits=1).toPandas()
    frame = frame.assign(k=[hashlib.md5(f"7:{i}".encode()).hexdigest() for i in frame.item_id])
    want = frame.sort_values("k").assign(r=lambda d: d.groupby("g").cumcount() + 1).set_index("item_id")["r"]
    assert (got.set_index("item_id")["rank"].sort_index() == want.sort_index()).all()
    pick = O.select_by_key(keyed, "k", "item_id", O.budget_size("group_n", 0.2), ["g"], digits=1).toPandas()
    sizes = frame.groupby("g").size()
    top = set(want[want <= np.ceil(sizes.loc[frame.set_index("item_id").loc[want.index, "g"]].to_numpy() * 0.2)].index)
    assert set(pick["item_id"]) == top


def test_results_do_not_depend_on_partitioning(df):
    a = O.queue(df, [F.desc("s"), "item_id"], 0.2, ["g"], segments=3).where("selected").select("item_id")
    b = O.queue(df.repartition(2), [F.desc("s"), "item_id"], 0.2, ["g"], segments=9).where("selected").select("item_id")
    assert {r[0] for r in a.collect()} == {r[0] for r in b.collect()}


def test_no_single_task_window_over_items(df):
    plan = O.queue(df, [F.desc("s"), "item_id"], 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan


def test_lookup_both_ways(spark, df):
    table = spark.createDataFrame([("a", 1), ("b", 2), ("hot", 3)], "g string, v int")
    few = O.lookup(df, table, "g", "item_id", limit=10)
    many = O.lookup(df, table, "g", "item_id", limit=1, salts=4)
    key = lambda d: sorted((r["item_id"], r["v"] or 0) for r in d.collect())
    assert key(few) == key(many)


def test_budget_edges(spark):
    df = spark.createDataFrame([(str(i), float(i)) for i in range(10)], "item_id string, s double")
    assert O.queue(df, ["s", "item_id"], 0.0).where("selected").count() == 0
    assert O.queue(df.limit(0), ["s", "item_id"], 0.2).count() == 0
    n = spark.createDataFrame([(762,), (2518,)], "n int").select(O.budget_size("n", 0.2).alias("k")).collect()
    assert [r["k"] for r in n] == [153, 504]
    with pytest.raises(ValueError):
        O.queue(df, ["s"], 1.1)


@pytest.mark.parametrize("limit", [2, 1000])
def test_value_join_and_a_hot_value(spark, limit, monkeypatch):
    monkeypatch.setattr(O, "HEAVY", limit)
    n = 3000
    rows = [(i, 7 if i % 3 == 0 else (None if i % 50 == 1 else i)) for i in range(n)]
    df = materialise(spark.createDataFrame(rows, "i long, v long"), "rows")
    table = materialise(df.groupBy("v").agg(F.count(F.lit(1)).alias("rows"), F.max("i").alias("last")), "table")
    got = {(r.i, r.v, r.last) for r in O.value_join(df, table, ["v"], "rows").collect()}
    last = {}
    for i, v in rows:
        last[v] = max(last.get(v, -1), i)
    assert got == {(i, v, last[v]) for i, v in rows}


def test_hot_rows_are_not_shuffled_by_value(spark):
    n = 40_000
    df = materialise(spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v")), "rows")
    table = materialise(df.groupBy("v").agg(F.count(F.lit(1)).alias("rows"), F.lit(1).alias("x")), "table")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        sizes = O.value_join(df, table, ["v"], "rows").groupBy(F.spark_partition_id()).count().toPandas()["count"]
        plan = O.value_join(df, table, ["v"], "rows")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    assert sizes.sum() == n and "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    assert sizes.max() <= 3 * sizes.median()  # unshuffled scan parts of the hot rows, even parts of the rest


def test_lookup_beyond_the_limit_is_not_broadcast(spark):
    """The copies of a table of few bytes are many rows; sent to every task they would first meet in the driver."""
    table = materialise(spark.range(2000).withColumnRenamed("id", "g"), "few-bytes").withColumn("z", F.col("g") * 2)
    rows = spark.range(5000).withColumnRenamed("id", "g")
    out = O.lookup(rows, table, "g", "g", limit=100)
    assert out.agg(F.count("z"), F.count(F.lit(1))).first() == (2000, 5000)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
