"""Section I: ranking, budgets and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from marklens.functions import scalars as S
from marklens.operators import drift as D
from marklens.operators import queues as Q
from marklens.operators.order import average_ranks, budget_size, queue, with_row
from marklens.plans import sqltext as Z
from marklens.plans.metric_queries import _CENTRES, _STRATS, _ranked_strategies
from marklens.plans.registry import query
from marklens.plans.sqltext import n_if, r, rounded
from marklens.plans.views import scored, with_signals, with_views

c = F.col


@query("i1_queue_size", with_views("scored", "SELECT split, count(*) AS n, CAST(ceil(count(*)*0.1::DOUBLE) AS BIGINT) AS k10, CAST(ceil(count(*)*0.2::DOUBLE) AS BIGINT) AS k20, CAST(ceil(count(*)*0.3::DOUBLE) AS BIGINT) AS k30 FROM scored GROUP BY split"))
def _i1(spark, sf):
    n = scored(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumns({f"k{int(b * 100)}": budget_size("n", b) for b in (0.1, 0.2, 0.3)})


def _ranked_sql(order: str, extra: str = "", source: str = "signals") -> str:
    return f"""SELECT item_id, rank, rank <= ceil(n_all*0.2::DOUBLE) AS selected FROM (SELECT item_id,
    row_number() OVER (ORDER BY {order}) AS rank, count(*) OVER () AS n_all FROM {source}{extra}) AS z"""


def _out(df):
    return df.select("item_id", "rank", "selected")


@query("i2_shortest_first", with_views("signals", _ranked_sql("word_count, item_id")))
def _i2(spark, sf):
    return _out(queue(scored(spark, sf).select("item_id", "word_count"), ["word_count", "item_id"], 0.2))


@query("i3_extremity", with_views("signals", f"WITH {_CENTRES} " + _ranked_sql("greatest(abs(lin_v-cv), abs(lin_g-cg)) DESC, item_id", ", ctr")))
def _i3(spark, sf):
    s = scored(spark, sf)
    s = with_row(s, Q.linear_centres(s.where("split = 'model_train'")))
    ext = Q.extremity(c("lin_v"), c("lin_g"), c("centre_v"), c("centre_g"))
    return _out(queue(s.select("item_id", ext.alias("ext")), [F.desc("ext"), "item_id"], 0.2))


@query("i4_disagreement", with_views("signals", _ranked_sql("d_max DESC, item_id")))
def _i4(spark, sf):
    return _out(queue(with_signals(spark, sf).select("item_id", "d_max"), [F.desc("d_max"), "item_id"], 0.2))


@query("i5_top_ids", with_views("signals", """SELECT 'mean_disagreement' AS ranking, item_id FROM (SELECT item_id, row_number() OVER (ORDER BY d_mean DESC, item_id) AS k, count(*) OVER () AS n FROM signals) WHERE k<=ceil(n*0.1::DOUBLE)
UNION ALL SELECT 'lowest_forest', item_id FROM (SELECT item_id, row_number() OVER (ORDER BY for_v, item_id) AS k, count(*) OVER () AS n FROM signals) WHERE k<=ceil(n*0.1::DOUBLE)"""))
def _i5(spark, sf):
    s = with_signals(spark, sf)
    top = Q.ranked_strategies(s, {"mean_disagreement": c("d_mean"), "lowest_forest": -c("for_v")}, [])
    return Q.select_budget(top, 0.1).where("selected").select(c("strategy").alias("ranking"), "item_id")


@query("i6_fold_queue", with_views("signals", """SELECT item_id, cv_fold, rank, rank<=k AS selected, round(k/n, 9) AS inclusion FROM (SELECT item_id, cv_fold, row_number() OVER (PARTITION BY cv_fold ORDER BY d_max DESC, item_id) AS rank,
count(*) OVER (PARTITION BY cv_fold) AS n, ceil(count(*) OVER (PARTITION BY cv_fold)*0.2::DOUBLE) AS k FROM signals WHERE cv_fold IS NOT NULL)"""))
def _i6(spark, sf):
    s = with_signals(spark, sf).where(c("cv_fold").isNotNull()).select("item_id", "cv_fold", "d_max")
    q = queue(s, [F.desc("d_max"), "item_id"], 0.2, ["cv_fold"])
    return q.select("item_id", "cv_fold", "rank", "selected", F.round(c("queue_size") / c("group_n"), 9).alias("inclusion"))


@query("i7_signal_rankings", with_views("signals", f"""WITH {_CENTRES}, s AS (SELECT item_id, large, 'longest_first' AS strategy, word_count AS score FROM signals UNION ALL SELECT item_id, large, 'forest_extremity', greatest(abs(for_v-cv), abs(for_g-cg)) FROM signals, ctr
UNION ALL SELECT item_id, large, 'target_gap', abs(for_v-for_g) FROM signals), k AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY score DESC, item_id) AS rank, count(*) OVER (PARTITION BY strategy) AS n FROM s)
SELECT strategy, {n_if('rank<=ceil(n*0.2::DOUBLE)')} AS selected_count, {n_if('large AND rank<=ceil(n*0.2::DOUBLE)')} AS captured FROM k GROUP BY strategy"""))
def _i7(spark, sf):
    s = with_signals(spark, sf)
    s = with_row(s, Q.linear_centres(s.where("split = 'model_train'")))
    ranked = Q.ranked_strategies(s, {
        "longest_first": c("word_count"), "target_gap": F.abs(c("for_v") - c("for_g")),
        "forest_extremity": Q.extremity(c("for_v"), c("for_g"), c("centre_v"), c("centre_g")),
    }, ["large"])
    m = Q.queue_metrics(Q.select_budget(ranked), ["strategy"])
    return m.select("strategy", "selected_count", "captured")


@query("i8_largest_errors", with_views("long", """SELECT target, model, item_id, error FROM (SELECT target, model, item_id, abs(prediction-truth) AS error, row_number() OVER (PARTITION BY target, model ORDER BY abs(prediction-truth) DESC, item_id) AS k FROM long) WHERE k<=10"""))
def _i8(spark, sf):
    from marklens.plans.views import long_scores

    rows = long_scores(spark, sf).select("target", "model", "item_id", F.abs(c("prediction") - c("truth")).alias("error"))
    return Q.top_per_group(rows, ["target", "model"], c("error"), "item_id", 10)


@query("i9_batch_prioritisation", with_views("signals", """SELECT item_id, lin_v AS vocabulary_linear, for_g AS grammar_forest, d_max AS disagreement, concat_ws(',', CASE WHEN d_v>=0.5 THEN 'vocabulary' END, CASE WHEN d_g>=0.5 THEN 'grammar' END) AS reasons,
row_number() OVER (ORDER BY d_max DESC, item_id) AS rank, row_number() OVER (ORDER BY d_max DESC, item_id) <= ceil(count(*) OVER ()*0.2::DOUBLE) AS review_first FROM signals"""))
def _i9(spark, sf):
    out = Q.prioritise(scored(spark, sf), budget=0.2, threshold=0.5)
    return out.select(
        "item_id", c("scores.vocabulary.linear").alias("vocabulary_linear"), c("scores.grammar.forest").alias("grammar_forest"),
        c("disagreement.maximum").alias("disagreement"), F.array_join("reasons", ",").alias("reasons"), "rank", "review_first",
    )


@query("i10_budget_curve", with_views("signals", f"""WITH f AS (SELECT cv_fold, max_err, row_number() OVER (PARTITION BY cv_fold ORDER BY d_max DESC, item_id) AS rank, count(*) OVER (PARTITION BY cv_fold) AS n FROM signals WHERE cv_fold IS NOT NULL),
b AS (SELECT b::DOUBLE AS budget FROM (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5]) AS b)), t AS (SELECT t::DOUBLE AS threshold FROM (SELECT unnest([0.5, 1.0, 1.5]) AS t))
SELECT budget, threshold, {n_if('rank<=ceil(n*budget)')} AS selected_count, {n_if('max_err>=threshold')} AS positives, {n_if('max_err>=threshold AND rank<=ceil(n*budget)')} AS captured FROM f, b, t GROUP BY budget, threshold"""))
def _i10(spark, sf):
    s = with_signals(spark, sf).where(c("cv_fold").isNotNull())
    ranked = Q.ranked_strategies(s, {"disagreement": c("d_max")}, ["max_err", "cv_fold"], ["cv_fold"])
    grid = Q.sensitivity_grid(ranked, (0.5, 1.0, 1.5), (0.05, 0.1, 0.2, 0.3, 0.5), ["strategy"])
    return grid.select("budget", "threshold", "selected_count", "positives", "captured")


@query("i11_average_ranks", with_views("signals", "SELECT d_max, count(*) AS n, avg(rn) AS avg_rank FROM (SELECT d_max, row_number() OVER (ORDER BY d_max) AS rn FROM signals) GROUP BY d_max"))
def _i11(spark, sf):
    return average_ranks(with_signals(spark, sf), "d_max").select("d_max", "n", "avg_rank")


_ZF = ("word_count", "lin_v", "for_v", "lin_g", "for_g")


@query("i12_z_profile", with_views("scored", f"""WITH u AS ({' UNION ALL '.join(f"SELECT item_id, '{x}' AS feature, ({x}-avg({x}) OVER ())/stddev_pop({x}) OVER () AS z FROM scored" for x in _ZF)}),
k AS (SELECT item_id, feature, round(z, 7) AS z, CAST(row_number() OVER (PARTITION BY item_id ORDER BY abs(z) DESC, feature) AS INT) AS z_rank FROM u) SELECT * FROM k"""))
def _i12(spark, sf):
    return D.z_profile(scored(spark, sf), "item_id", _ZF).withColumn("z", F.round("z", 7))


@query("i13_best_strategy", with_views("signals", f"""WITH {_STRATS}, m AS (SELECT strategy, {n_if('large AND rank<=ceil(n_all*0.2::DOUBLE)')}/{n_if('large')} AS capture FROM rk GROUP BY strategy)
SELECT round(max(capture), 9) AS best_capture, string_agg(strategy, ',' ORDER BY strategy) AS strategies FROM m WHERE capture=(SELECT max(capture) FROM m)"""))
def _i13(spark, sf):
    m = Q.queue_metrics(Q.select_budget(_ranked_strategies(spark, sf)), ["strategy"])
    return rounded(Q.best_strategies(m))
