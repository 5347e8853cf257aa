"""Section H: metric tables, queue metrics, grids, quadrants, group summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marklens.functions import draws as D
from marklens.functions import metrics as M
from marklens.functions import scalars as S
from marklens.operators import evaluation as E
from marklens.operators import groups as G
from marklens.operators import profile as P
from marklens.operators import queues as Q
from marklens.operators.order import quantiles, queue, rank_rows, with_row
from marklens.plans import sqltext as Z
from marklens.plans.registry import query
from marklens.plans.sqltext import n_if, r, rounded
from marklens.plans.views import long_scores, ratings, scored, table, with_signals, with_views

c = F.col


def _sql(views: str, body: str) -> str:
    return with_views(views, body)


# ---- regression metrics -------------------------------------------------------------------------

@query("h1_regression_metrics", _sql("long", f"SELECT split, target, model, {r(Z.mae(), 'mae')}, {r(Z.rmse(), 'rmse')}, {r(Z.r2(), 'r2')} FROM long GROUP BY ALL"))
def _h1(spark, sf):
    y, p = c("truth"), c("prediction")
    cols = {"mae": M.mae(y, p), "rmse": M.rmse(y, p), "r2": M.r2(y, p)}
    return rounded(long_scores(spark, sf).groupBy("split", "target", "model").agg(*M.named(cols)))


@query("h2_quadratic_kappa", _sql("long", f"SELECT split, target, model, {r(Z.qwk(), 'qwk')} FROM long GROUP BY ALL"))
def _h2(spark, sf):
    return rounded(
        long_scores(spark, sf).groupBy("split", "target", "model").agg(M.score_kappa(c("truth"), c("prediction")).alias("qwk"))
    )


_H3 = f"SELECT target, model, count(*) AS n_samples, {r(Z.mae(), 'mae')}, {r(Z.rmse(), 'rmse')}, {r(Z.r2(), 'r2')}, {r(Z.qwk(), 'qwk')} FROM long GROUP BY ALL"


@query("h3_metric_table", _sql("long", _H3))
def _h3(spark, sf):
    return rounded(E.metric_table(long_scores(spark, sf)))


def _scorer_rows(spark, sf):
    return scored(spark, sf).select(
        F.expr("stack(6, 'V','human',y_v, 'V','linear',lin_v, 'V','forest',for_v, 'G','human',y_g, 'G','linear',lin_g, 'G','forest',for_g) AS (target, scorer, score)")
    )


_SCORERS = " UNION ALL ".join(
    f"SELECT '{t}' AS target, '{s}' AS scorer, {col}_{t.lower()} AS score FROM scored" for t in "VG" for s, col in (("human", "y"), ("linear", "lin"), ("forest", "for"))
)


@query(
    "h4_scorer_distribution",
    _sql("scored", f"""WITH s AS ({_SCORERS}) SELECT target, scorer, count(*) AS n, {r('avg(score)', 'mean')}, {r('stddev_samp(score)', 'sd')},
    min(score) AS minimum, max(score) AS maximum, {r(Z.q('score', .25), 'q25')}, {r(Z.q('score', .5), 'median')}, {r(Z.q('score', .75), 'q75')} FROM s GROUP BY ALL"""),
)
def _h4(spark, sf):
    return rounded(E.distribution_table(_scorer_rows(spark, sf), "score", ["target", "scorer"]))


@query(
    "h5_machine_by_human_score",
    _sql("long", f"""SELECT target, model, truth, count(*) AS n, {r('avg(prediction)', 'mean_prediction')}, {r('stddev_samp(prediction)', 'sd_prediction')},
    {r('avg(prediction-truth)', 'bias')}, {r(Z.mae(), 'mae')}, {r(Z.within(0.5), 'within_half')}, {r(Z.within(1), 'within_one')} FROM long GROUP BY ALL"""),
)
def _h5(spark, sf):
    return rounded(E.by_truth_table(long_scores(spark, sf)))


@query(
    "h6_point_predictors",
    _sql("long", f"""WITH m AS (SELECT target, model, {Z.mae()} AS mae FROM long GROUP BY ALL),
    w AS (SELECT target, max(mae) FILTER (WHERE model='linear') AS a, max(mae) FILTER (WHERE model='forest') AS b FROM m GROUP BY target)
    SELECT target, CASE WHEN b < a - 1e-12 THEN 'forest' ELSE 'linear' END AS selected_model, {r('least(a, b)', 'selected_mae')} FROM w"""),
)
def _h6(spark, sf):
    return rounded(E.point_predictors(E.metric_table(long_scores(spark, sf)), "linear", "forest"))


def _baselines(spark, sf):
    """Two baselines per target: the constant mean and the line on word count."""
    human = _truth_rows(spark, sf)
    mean = E.mean_baseline(human).select("target", F.lit("mean").alias("baseline"), "mae")
    line = human.groupBy("target").agg(
        M.slope(c("truth"), c("word_count")).alias("_b"), F.avg("truth").alias("_ym"), F.avg("word_count").alias("_xm")
    )
    fitted = human.join(F.broadcast(line), "target")  # two rows, one per target
    pred = c("_ym") + c("_b") * (c("word_count") - c("_xm"))
    length = fitted.groupBy("target").agg(F.avg(F.abs(pred - c("truth"))).alias("mae"))
    return mean.unionByName(length.select("target", F.lit("length").alias("baseline"), "mae"))


def _truth_rows(spark, sf):
    return scored(spark, sf).select("item_id", "word_count", F.expr("stack(2, 'V', y_v, 'G', y_g) AS (target, truth)"))


@query(
    "h7_baseline_comparison",
    _sql("long", f"""WITH h AS (SELECT target, truth, word_count FROM long WHERE model='linear'),
    a AS (SELECT target, avg(truth) AS ym, avg(word_count) AS xm, {Z.slope('truth', 'word_count')} AS b FROM h GROUP BY target),
    bl AS (SELECT h.target, 'mean' AS baseline, avg(abs(truth-ym)) AS bmae FROM h JOIN a ON h.target=a.target GROUP BY h.target
    UNION ALL SELECT h.target, 'length', avg(abs(ym+b*(word_count-xm)-truth)) FROM h JOIN a ON h.target=a.target GROUP BY h.target),
    m AS (SELECT target, model, {Z.mae()} AS mae FROM long GROUP BY ALL)
    SELECT m.target, model, baseline, {r('bmae-mae', 'mae_reduction')}, {r('100*(bmae-mae)/bmae', 'improvement_percent', 7)} FROM m JOIN bl ON m.target=bl.target"""),
)
def _h7(spark, sf):
    out = E.baseline_comparison(E.metric_table(long_scores(spark, sf)), _baselines(spark, sf))
    return out.withColumns({"mae_reduction": F.round("mae_reduction", 9), "improvement_percent": F.round("improvement_percent", 7)})


@query("h8_error_table", _sql("long", "SELECT item_id, target, model, truth, prediction, prediction-truth AS residual, abs(prediction-truth) AS absolute_error FROM long"))
def _h8(spark, sf):
    return E.error_table(long_scores(spark, sf)).select("item_id", "target", "model", "truth", "prediction", "residual", "absolute_error")


@query("h9_residuals_worst_first", _sql("scored", "SELECT item_id, y_v AS reference, for_v AS predicted, y_v-for_v AS residual, abs(y_v-for_v) AS absolute_error FROM scored ORDER BY absolute_error DESC, item_id"))
def _h9(spark, sf):
    s = scored(spark, sf).select(
        "item_id", c("y_v").alias("reference"), c("for_v").alias("predicted"), (c("y_v") - c("for_v")).alias("residual"),
        F.abs(c("y_v") - c("for_v")).alias("absolute_error"),
    )
    return s.orderBy(F.desc("absolute_error"), "item_id")


@query(
    "h10_error_summary",
    _sql("long", f"""SELECT target, model, {r(Z.mae(), 'mean_error')}, max(abs(prediction-truth)) AS max_error, {n_if('prediction<1')} AS below_scale,
    {n_if('prediction>5')} AS above_scale, {r(Z.q('abs(prediction-truth)', .5), 'median_error')}, {r(Z.q('abs(prediction-truth)', .9), 'p90_error')} FROM long GROUP BY ALL"""),
)
def _h10(spark, sf):
    return rounded(E.error_summary(long_scores(spark, sf)))


@query(
    "h11_grouped_mae",
    _sql("long", f"""WITH q AS (SELECT quantile_cont(word_count, 0.25) AS a, quantile_cont(word_count, 0.5) AS b, quantile_cont(word_count, 0.75) AS d FROM long WHERE split='model_train' AND target='V' AND model='forest'),
    g AS (SELECT target, model, truth, prediction, CASE WHEN word_count<a THEN 'Q1' WHEN word_count<b THEN 'Q2' WHEN word_count<d THEN 'Q3' ELSE 'Q4' END AS lb,
    CASE WHEN truth<2 THEN '<2' WHEN truth<3 THEN '2-<3' WHEN truth<4 THEN '3-<4' ELSE '4+' END AS sb FROM long, q WHERE model='forest'),
    u AS (SELECT target, model, truth, prediction, 'length_band' AS group_type, lb AS group_value FROM g UNION ALL SELECT target, model, truth, prediction, 'score_band', sb FROM g)
    SELECT target, model, group_type, group_value, count(*) AS n, {r(Z.mae(), 'mae')}, {r(Z.rmse(), 'rmse')}, {r('avg(prediction-truth)', 'bias')} FROM u GROUP BY ALL HAVING count(*) >= 20"""),
)
def _h11(spark, sf):
    s = scored(spark, sf)
    banded = G.quantile_bands(long_scores(spark, sf).where("model = 'forest'"), s.where("split = 'model_train'"), "word_count", "length_band")
    groupings = {"length_band": c("length_band"), "score_band": S.left_closed_band(c("truth"), [2, 3, 4], ["<2", "2-<3", "3-<4", "4+"])}
    return rounded(E.grouped_metrics(banded, groupings, 20))


_EXT = (
    f"{r(Z.mae(), 'mae')}, {r(Z.rmse(), 'rmse')}, {r(Z.r2(), 'r2')}, {r('avg(prediction-truth)', 'mean_bias')}, {r(Z.within(0.5), 'within_half')}, "
    f"{r(Z.within(1), 'within_one')}, {r(Z.slope(), 'calibration_slope')}, {r('stddev_samp(prediction)', 'prediction_sd')}, {r('stddev_samp(truth)', 'human_sd')}"
)


@query("h12_extended_metrics", _sql("long", f"SELECT target, model, {_EXT} FROM long GROUP BY ALL"))
def _h12(spark, sf):
    return rounded(E.extended_table(long_scores(spark, sf), ["target", "model"]))


@query("h13_calibration_slope", _sql("long", f"SELECT target, model, cluster, {r(Z.slope(), 'calibration_slope')} FROM long GROUP BY ALL"))
def _h13(spark, sf):
    return rounded(long_scores(spark, sf).groupBy("target", "model", "cluster").agg(M.slope(c("truth"), c("prediction")).alias("calibration_slope")))


_BAND = "CASE WHEN truth<=2.5 THEN 'low' WHEN truth<=3.5 THEN 'middle' WHEN truth>=4 THEN 'high' ELSE 'invalid' END"
_BANDS_SQL = f"""SELECT target, model, {_BAND} AS band, count(*) AS n, {r(Z.mae(), 'mae')}, {r('avg(prediction-truth)', 'signed_bias')},
{r(Z.within(0.5), 'within_half')}, {r(Z.within(1), 'within_one')} FROM long GROUP BY ALL"""


@query("h14_band_metrics", _sql("long", _BANDS_SQL))
def _h14(spark, sf):
    return rounded(E.band_table(long_scores(spark, sf), ["target", "model"]))


@query(
    "h15_fold_interval",
    _sql("long", f"""WITH f AS (SELECT target, model, cv_fold, {Z.mae()} AS mae FROM long WHERE cv_fold IS NOT NULL GROUP BY ALL)
    SELECT target, model, count(*) AS folds, {r('avg(mae)', 'mean')}, {r('avg(mae)-2.776445105*stddev_samp(mae)/sqrt(count(*))', 'low')},
    {r('avg(mae)+2.776445105*stddev_samp(mae)/sqrt(count(*))', 'high')} FROM f GROUP BY ALL"""),
)
def _h15(spark, sf):
    folds = E.metric_table(long_scores(spark, sf).where(c("cv_fold").isNotNull()), ["target", "model", "cv_fold"])
    return rounded(E.fold_interval(folds, ["target", "model"]))


@query(
    "h16_acceptance",
    _sql("long", f"""WITH v AS (SELECT target, model AS variant, cv_fold, truth, prediction FROM long WHERE cv_fold IS NOT NULL
      UNION ALL SELECT target, 'blend', cv_fold, truth, avg(prediction) FROM long WHERE cv_fold IS NOT NULL GROUP BY target, cv_fold, truth, item_id),
    o AS (SELECT target, variant, {Z.mae()} AS mae FROM v GROUP BY ALL),
    b AS (SELECT target, variant, {_BAND} AS band, {Z.mae()} AS mae, abs(avg(prediction-truth)) AS ab FROM v GROUP BY ALL),
    f AS (SELECT target, variant, cv_fold, {Z.mae()} AS mae FROM v GROUP BY ALL),
    oc AS (SELECT x.target, x.variant, x.mae-y.mae AS overall_change FROM o x JOIN o y ON x.target=y.target AND y.variant='linear' WHERE x.variant<>'linear'),
    bc AS (SELECT x.target, x.variant, (avg(y.mae)-avg(x.mae))/avg(y.mae) AS macro_gain, max(x.ab) FILTER (WHERE x.band<>'middle') AS tail,
      max(y.ab) FILTER (WHERE y.band<>'middle') AS base_tail, max(x.mae-y.mae) AS worst FROM b x JOIN b y ON x.target=y.target AND x.band=y.band AND y.variant='linear'
      WHERE x.variant<>'linear' GROUP BY x.target, x.variant),
    fc AS (SELECT x.target, x.variant, {n_if('x.mae<y.mae')} AS improved_folds FROM f x JOIN f y ON x.target=y.target AND x.cv_fold=y.cv_fold AND y.variant='linear'
      WHERE x.variant<>'linear' GROUP BY x.target, x.variant),
    z AS (SELECT oc.target, oc.variant, overall_change, macro_gain, coalesce((base_tail-tail)/nullif(base_tail, 0), 0) AS tail_cut, worst, improved_folds
      FROM oc JOIN bc ON oc.target=bc.target AND oc.variant=bc.variant JOIN fc ON oc.target=fc.target AND oc.variant=fc.variant)
    SELECT target, variant, {r('overall_change', 'overall_change')}, {r('macro_gain', 'macro_gain')}, {r('tail_cut', 'tail_cut', 7)}, {r('worst', 'worst_band_increase')}, improved_folds,
    overall_change<=0.005 AS overall_pass, macro_gain>=0.1 AS macro_pass, tail_cut>=0.2 AS tail_pass, worst<=0.05 AS group_pass, improved_folds>=4 AS folds_pass,
    overall_change<=0.005 AND macro_gain>=0.1 AND tail_cut>=0.2 AND worst<=0.05 AND improved_folds>=4 AS accepted FROM z"""),
)
def _h16(spark, sf):
    s = scored(spark, sf).where(c("cv_fold").isNotNull())
    long = s.select(
        c("cv_fold").alias("fold"),
        F.expr("stack(6, 'V','linear',y_v,lin_v, 'V','forest',y_v,for_v, 'V','blend',y_v,(lin_v+for_v)/2, 'G','linear',y_g,lin_g, 'G','forest',y_g,for_g, 'G','blend',y_g,(lin_g+for_g)/2) AS (target, variant, truth, prediction)"),
    )
    out = E.acceptance(*E.error_cells(long), "linear")
    return rounded(out.withColumn("tail_cut", F.round("tail_cut", 7)))


# ---- review queues ------------------------------------------------------------------------------

_RANKED = "ranked AS (SELECT *, row_number() OVER (ORDER BY d_max DESC, item_id) AS rank, row_number() OVER (ORDER BY word_count, item_id) AS srank, count(*) OVER () AS n_all FROM signals)"
_SEL = "rank <= ceil(n_all*0.2::DOUBLE)"
_QCOLS = (
    f"count(*) AS n, {n_if('sel')} AS selected_count, {n_if('large')} AS positives, {n_if('large AND sel')} AS captured, {r(n_if('large') + '/count(*)', 'prevalence')}, "
    f"{r(n_if('large AND sel') + '/nullif(' + n_if('large') + ', 0)', 'capture_rate')}, {r(n_if('large AND sel') + '/nullif(' + n_if('sel') + ', 0)', 'precision')}, "
    f"{r('(' + n_if('large AND sel') + '/nullif(' + n_if('sel') + ', 0))/nullif(' + n_if('large') + '/count(*), 0)', 'lift')}"
)


def _disagreement_queue(spark, sf, keep=("prompt_id", "large", "max_err")):
    s = with_signals(spark, sf).select("item_id", "d_max", *keep)
    return queue(s, [F.desc("d_max"), "item_id"], 0.2)


@query("h17_queue_metrics", _sql("signals", f"WITH {_RANKED}, s AS (SELECT *, {_SEL} AS sel FROM ranked) SELECT prompt_id, {_QCOLS} FROM s GROUP BY prompt_id"))
def _h17(spark, sf):
    return rounded(Q.queue_metrics(_disagreement_queue(spark, sf), ["prompt_id"]))


@query(
    "h18_capture_at_threshold",
    _sql("signals", f"""WITH {_RANKED}, s AS (SELECT *, {_SEL} AS sel FROM ranked), t AS (SELECT unnest([0.5, 1.0, 1.5, 9.0])::DOUBLE AS threshold)
    SELECT threshold, {r('coalesce(' + n_if('max_err>=threshold AND sel') + '/nullif(' + n_if('max_err>=threshold') + ', 0), 0)', 'capture_rate')} FROM s, t GROUP BY threshold"""),
)
def _h18(spark, sf):
    q = _disagreement_queue(spark, sf)
    rates = F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.coalesce(M.safe_ratio(F.count_if((c("max_err") >= t) & c("selected")), F.count_if(c("max_err") >= t)), F.lit(0.0)).alias("capture_rate"))
        for t in (0.5, 1.0, 1.5, 9.0)
    ])
    return rounded(q.agg(rates.alias("x")).select(F.inline("x")))


_CENTRES = "ctr AS (SELECT quantile_cont(lin_v, 0.5) FILTER (WHERE split='model_train') AS cv, quantile_cont(lin_g, 0.5) FILTER (WHERE split='model_train') AS cg FROM scored)"
_STRATS = f"""{_CENTRES}, st AS (SELECT item_id, prompt_id, split, cv_fold, large, max_err, 'disagreement' AS strategy, d_max AS score FROM signals
UNION ALL SELECT item_id, prompt_id, split, cv_fold, large, max_err, 'shortest_first', -word_count FROM signals
UNION ALL SELECT item_id, prompt_id, split, cv_fold, large, max_err, 'extremity', greatest(abs(lin_v-cv), abs(lin_g-cg)) FROM signals, ctr),
rk AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY score DESC, item_id) AS rank, count(*) OVER (PARTITION BY strategy) AS n_all FROM st)"""


def _ranked_strategies(spark, sf, keep=("large", "max_err"), partition=()):
    s = with_signals(spark, sf)
    s = with_row(s, Q.linear_centres(s.where("split = 'model_train'")))
    return Q.ranked_strategies(s, Q.standard_strategies(), [*keep, *partition], partition)


@query("h19_metrics_per_strategy", _sql("signals", f"WITH {_STRATS}, s AS (SELECT *, {_SEL} AS sel FROM rk) SELECT strategy, {_QCOLS} FROM s GROUP BY strategy"))
def _h19(spark, sf):
    return rounded(Q.queue_metrics(Q.select_budget(_ranked_strategies(spark, sf)), ["strategy"]))


@query(
    "h20_sensitivity_grid",
    _sql("signals", f"""WITH {_STRATS}, gr AS (SELECT t::DOUBLE AS threshold, b::DOUBLE AS budget FROM (SELECT unnest([0.5, 1.0, 1.5]) AS t) x, (SELECT unnest([0.1, 0.2, 0.3]) AS b) y),
    z AS (SELECT strategy, threshold, budget, max_err>=threshold AS large, rank<=ceil(n_all*budget) AS sel FROM rk, gr)
    SELECT strategy, threshold, budget, count(*) AS n, {n_if('sel')} AS selected_count, {n_if('large')} AS positives, {n_if('large AND sel')} AS captured,
    {r(n_if('large AND sel') + '/nullif(' + n_if('large') + ', 0)', 'capture_rate')}, {r(n_if('large AND sel') + '/nullif(' + n_if('sel') + ', 0)', 'precision')},
    {r('(' + n_if('large AND sel') + '/nullif(' + n_if('sel') + ', 0))/nullif(' + n_if('large') + '/count(*), 0)', 'lift')}, threshold=1.0 AND budget=0.2 AS "primary"
    FROM z GROUP BY strategy, threshold, budget"""),
)
def _h20(spark, sf):
    return rounded(Q.sensitivity_grid(_ranked_strategies(spark, sf)), skip=("threshold", "budget"))


_QUAD = "CASE WHEN d_max>=m THEN 'high_d' ELSE 'low_d' END || '_' || CASE WHEN large THEN 'large' ELSE 'other' END"


@query("h21_error_quadrants", _sql("signals", f"WITH md AS (SELECT quantile_cont(d_max, 0.5) AS m FROM signals) SELECT {_QUAD} AS quadrant, count(*) AS n, {r('avg(max_err)', 'mean_error')} FROM signals, md GROUP BY ALL"))
def _h21(spark, sf):
    s = Q.error_quadrants(with_signals(spark, sf))
    return rounded(s.groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"), F.avg("max_err").alias("mean_error")))


_GS = (
    f"count(*) AS n, {r('avg(d_max)', 'mean_disagreement')}, {r('avg(max_err)', 'mean_max_error')}, {r('avg(word_count)', 'mean_words')}, {n_if('large')} AS large_count, {r('avg(large::INT)', 'prevalence')}, "
    + ", ".join(
        f"{r(f'avg(for_{t}-y_{t})', f'{t}_mean_signed_error')}, {r(f'avg((for_{t}>y_{t})::INT)', f'{t}_over_rate')}, {r(f'avg((for_{t}<y_{t})::INT)', f'{t}_under_rate')}" for t in "vg"
    )
    + f", {r('100.0*count(*)/(SELECT count(*) FROM signals)', 'percentage')}"
)


@query("h22_group_summary", _sql("signals", f"SELECT segment, nullif(status, 'P') AS status_key, {_GS} FROM signals GROUP BY ALL"))
def _h22(spark, sf):
    s = with_signals(spark, sf).withColumn("status_key", F.nullif(c("status"), F.lit("P")))
    return rounded(G.group_summary(s, ["segment", "status_key"]))


@query(
    "c25_score_distribution_json",
    _sql("scored", """WITH k AS (SELECT segment, CASE WHEN y_v=floor(y_v) THEN CAST(CAST(y_v AS INT) AS VARCHAR) ELSE CAST(y_v AS VARCHAR) END AS s, count(*) AS n FROM scored GROUP BY ALL)
    SELECT segment, '{' || string_agg('"' || s || '":' || CAST(n AS VARCHAR), ',' ORDER BY s) || '}' AS v_scores FROM k GROUP BY segment"""),
)
def _c25(spark, sf):
    return G.score_distribution(scored(spark, sf), "y_v", ["segment"], "v_scores")


_HS = " UNION ALL ".join(f"SELECT '{t}' AS target, y_{t.lower()} AS human_score, for_{t.lower()}-y_{t.lower()} AS e, max_err, large, d_max FROM signals" for t in "VG")


@query(
    "h23_error_by_human_score",
    _sql("signals", f"""WITH u AS ({_HS}) SELECT target, human_score, count(*) AS n, {r('avg(abs(e))', 'mean_absolute_error')}, {r('avg(e)', 'mean_signed_error')}, {r('avg((e>0)::INT)', 'over_rate')},
    {r('avg((e<0)::INT)', 'under_rate')}, {r('avg(max_err)', 'mean_max_error')}, {n_if('large')} AS large_count, {r('avg(large::INT)', 'prevalence')}, {r('avg(d_max)', 'mean_disagreement')} FROM u GROUP BY ALL"""),
)
def _h23(spark, sf):
    u = with_signals(spark, sf).select("max_err", "large", "d_max", F.expr("stack(2, 'V', y_v, for_v-y_v, 'G', y_g, for_g-y_g) AS (target, human_score, e)"))
    return rounded(u.groupBy("target", "human_score").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("mean_absolute_error"), F.avg("e").alias("mean_signed_error"),
        F.avg((c("e") > 0).cast("double")).alias("over_rate"), F.avg((c("e") < 0).cast("double")).alias("under_rate"),
        F.avg("max_err").alias("mean_max_error"), F.count_if("large").alias("large_count"),
        F.avg(c("large").cast("double")).alias("prevalence"), F.avg("d_max").alias("mean_disagreement"),
    ), skip=("human_score",))


def _two_queues(spark, sf, keep):
    s = with_signals(spark, sf).select("item_id", "d_max", "word_count", *keep)
    a = queue(s, [F.desc("d_max"), "item_id"], 0.2).drop("rank", "group_n", "queue_size").withColumnRenamed("selected", "disagreement_selected")
    b = queue(a, ["word_count", "item_id"], 0.2)
    return b.withColumnRenamed("selected", "shortest_selected").drop("rank", "group_n", "queue_size")


@query(
    "h24_subgroup_table",
    _sql("signals", f"""WITH {_RANKED}, s AS (SELECT *, {_SEL} AS ds, srank <= ceil(n_all*0.2::DOUBLE) AS ss, nullif(status, 'P') AS st FROM ranked),
    u AS (SELECT 'cluster' AS attribute, cluster AS "group", * FROM s UNION ALL SELECT 'segment', segment, * FROM s UNION ALL SELECT 'st', coalesce(st, 'Missing'), * FROM s)
    SELECT attribute, "group", count(*) AS n, {r('avg(err_v)', 'mae_v')}, {r('avg(err_g)', 'mae_g')}, {n_if('large')} AS large_count, {r('avg(large::INT)', 'prevalence')},
    {n_if('ds')} AS disagreement_count, {r('avg(ds::INT)', 'disagreement_rate')}, {r(n_if('large AND ds') + '/nullif(' + n_if('large') + ', 0)', 'within_group_capture')},
    {n_if('ss')} AS shortest_count, {r('avg(ss::INT)', 'shortest_rate')}, {r('(SELECT avg(ds::INT) FROM s)', 'random_expected_rate')}, count(*)<20 AS small_n FROM u GROUP BY ALL"""),
)
def _h24(spark, sf):
    s = _two_queues(spark, sf, ["err_v", "err_g", "large", "cluster", "segment", F.nullif(c("status"), F.lit("P")).alias("st")])
    return rounded(G.subgroup_table(s, ["cluster", "segment", "st"]))


_H25_DRAWS, _H25_SEED = 1000, 42


def _h25_sql() -> str:
    """Cell after cell in a recursion: each step draws one (group, label) cell of an attribute from what is left."""
    choose = lambda a, b: f"(lgamma(({a})+1.0)-lgamma(({b})+1.0)-lgamma(({a})-({b})+1.0))"
    pmf = f"exp({choose('size', 'x')}+{choose('rest-size', 'open-x')}-{choose('rest', 'open')})"
    return f"""WITH RECURSIVE s AS (SELECT item_id, cluster, segment, large, row_number() OVER (ORDER BY d_max DESC, item_id) <= ceil(count(*) OVER ()*0.2::DOUBLE) AS sel FROM signals),
    u AS (SELECT 'cluster' AS attribute, 1 AS number, cluster AS grp, large, sel FROM s UNION ALL SELECT 'segment', 2, segment, large, sel FROM s),
    per AS (SELECT attribute, number, grp, count(*) AS n, {n_if('large')} AS positives, {n_if('sel')} AS selected, {n_if('large AND sel')} AS caught FROM u GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY grp)-1 AS i, sum(n) OVER (PARTITION BY attribute) AS whole FROM per),
    cells AS (SELECT number, attribute, i*2+l AS step, CASE WHEN l = 1 THEN positives ELSE n-positives END AS size, whole FROM placed, (SELECT unnest([0, 1]) AS l)),
    st AS (
      SELECT DISTINCT number, draw, -1::BIGINT AS step, whole::BIGINT AS rest, ceil(whole*0.2::DOUBLE)::BIGINT AS open, 0::BIGINT AS x FROM cells, (SELECT unnest(generate_series(1, {_H25_DRAWS}))::BIGINT AS draw)
      UNION ALL
      SELECT number, draw, step, rest-size, open-x, x FROM (
        SELECT *, row_number() OVER (PARTITION BY number, draw ORDER BY x DESC) AS place FROM (
          SELECT *, coalesce(sum(p) OVER (PARTITION BY number, draw ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)/sum(p) OVER (PARTITION BY number, draw) AS before FROM (
            SELECT number, draw, step, rest, open, size, x, {pmf} AS p, u FROM (
              SELECT *, unnest(generate_series(
                greatest(0, open+size-rest, floor(open*size/rest-12*sqrt(open*(size/rest)*(1-size/rest)*(rest-open)/greatest(rest-1, 1))-12))::BIGINT,
                least(open, size, ceil(open*size/rest+12*sqrt(open*(size/rest)*(1-size/rest)*(rest-open)/greatest(rest-1, 1))+12))::BIGINT)) AS x
              FROM (SELECT st.number, draw, c.step, rest, open, c.size, {D.uniform_sql('((st.number*1000003+c.step//2)*2+c.step%2)', 'draw', _H25_SEED)} FROM st JOIN cells c ON c.number = st.number AND c.step = st.step+1)
            )
          )
        ) WHERE before <= u
      ) WHERE place = 1
    ),
    means AS (SELECT number, step//2 AS i, sum(x) FILTER (WHERE step%2 = 1)/{_H25_DRAWS} AS hit, sum(x)/{_H25_DRAWS} AS drawn FROM st WHERE step >= 0 GROUP BY ALL),
    o AS (SELECT *, n >= 20 AS reported FROM placed JOIN means USING (number, i))
    SELECT attribute, grp, n, positives, reported, {', '.join(f'CASE WHEN reported THEN {e} END AS {k}' for k, e in (
        ('caught', 'caught'), ('selected', 'selected'), ('capture', 'round(caught/nullif(positives, 0), 9)'), ('selection_rate', 'round(selected/n, 9)'), ('random_mean_caught', 'round(hit, 9)'),
        ('random_mean_capture', 'round(hit/nullif(positives, 0), 9)'), ('random_mean_selected', 'round(drawn, 9)'), ('random_mean_rate', 'round(drawn/n, 9)'),
        ('note', "CASE WHEN positives < 10 THEN 'few positives' ELSE 'descriptive' END")))} FROM o"""


@query("h25_subgroup_random_capture", _sql("signals", _h25_sql()))
def _h25(spark, sf):
    s = queue(with_signals(spark, sf).select("item_id", "cluster", "segment", "large", "d_max"), [F.desc("d_max"), "item_id"], 0.2)
    return rounded(Q.subgroup_random_capture(s, ["cluster", "segment"], draws=_H25_DRAWS, budget=0.2, seed=_H25_SEED))


# ---- profiles and distributions -----------------------------------------------------------------

@query(
    "h26_column_profile",
    " UNION ALL ".join(
        f"SELECT 'documents' AS source, '{col}' AS column_name, '{t}' AS dtype, count({col}) AS non_null, count(*)-count({col}) AS missing, count(DISTINCT {col}) AS distinct_values FROM documents"
        for col, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))
    ) + " UNION ALL " + " UNION ALL ".join(
        f"SELECT 'labels', '{col}', '{t}', count({col}), count(*)-count({col}), count(DISTINCT {col}) FROM labels" for col, t in (("doc_id", "bigint"), ("quality", "int"), ("toxic", "int"))
    ),
)
def _h26(spark, sf):
    return P.column_profile({"documents": table(spark, sf, "documents"), "labels": table(spark, sf, "labels")})


_TRUTHS = "t AS (SELECT split, 'V' AS target, y_v AS score, word_count FROM scored UNION ALL SELECT split, 'G', y_g, word_count FROM scored)"


def _targets(spark, sf):
    return scored(spark, sf).select("split", F.expr("stack(2, 'V', y_v, 'G', y_g) AS (target, score)"))


@query("h27_score_distribution", _sql("scored", f"WITH {_TRUTHS}, k AS (SELECT split, target, score, count(*) AS n FROM t GROUP BY ALL) SELECT split, target, score, n, {r('100.0*n/sum(n) OVER (PARTITION BY split, target)', 'percent')} FROM k"))
def _h27(spark, sf):
    return rounded(P.score_shares(_targets(spark, sf), "score", ["split", "target"]), skip=("score",))


@query(
    "h28_length_summary",
    f"""WITH d AS (SELECT lang, text, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+(?:[''’-][\\p{{L}}\\p{{N}}_]+)*')) AS words FROM documents)
    SELECT lang, count(*) AS n, count(DISTINCT text) AS distinct_texts, {r('avg(words)', 'mean_words')}, {r('stddev_samp(words)', 'sd_words', 6)}, min(words) AS min_words, max(words) AS max_words,
    {r(Z.q('words', .25), 'q25')}, {r(Z.q('words', .5), 'median')}, {r(Z.q('words', .75), 'q75')}, {n_if('words<50')} AS under_50, {n_if('words<100')} AS under_100 FROM d GROUP BY lang""",
)
def _h28(spark, sf):
    d = table(spark, sf, "documents").select("lang", "text", S.word_count(c("text")).cast("bigint").alias("words"))
    out = P.length_summary(d, "words", "text", ["lang"])
    return rounded(out.withColumn("sd_words", F.round("sd_words", 6)))


@query(
    "h29_rater_columns",
    _sql("scored", " UNION ALL ".join(
        f"SELECT '{x}' AS column_name, count({x}) AS n, {r(f'avg({x})', 'mean')}, min({x}) AS minimum, max({x}) AS maximum, {n_if(f'{x}=0')} AS zeros FROM scored" for x in ("r1_v", "r2_v", "r1_g", "r2_g")
    )),
)
def _h29(spark, sf):
    return rounded(P.matching_columns(scored(spark, sf), r"^r[12]_[vg]$"))


@query(
    "h30_crosstab",
    _sql("scored", f"SELECT prompt_id, {n_if(chr(39).join(['split=', 'model_train', '']))} AS model_train, {n_if(chr(39).join(['split=', 'validation', '']))} AS validation, {n_if(chr(39).join(['split=', 'official_test', '']))} AS official_test, 0::BIGINT AS holdout FROM scored GROUP BY prompt_id"),
)
def _h30(spark, sf):
    return P.crosstab(scored(spark, sf), "prompt_id", "split", ["model_train", "validation", "official_test", "holdout"])


_NUM = ("word_count", "lin_v", "for_v", "lin_g", "for_g")


@query(
    "h31_wide_summary",
    _sql("scored", "SELECT split, " + ", ".join(
        f"count({x}) AS {x}_count, {r(f'avg({x})', f'{x}_mean')}, {r(f'stddev_samp({x})', f'{x}_std', 6)}, min({x}) AS {x}_min, max({x}) AS {x}_max" for x in _NUM) + " FROM scored GROUP BY split"),
)
def _h31(spark, sf):
    out = P.wide_summary(scored(spark, sf), list(_NUM), ["split"])
    return rounded(out.withColumns({f"{x}_std": F.round(f"{x}_std", 6) for x in _NUM}))


@query(
    "h32_length_by_prompt",
    _sql("scored", f"""WITH g AS (SELECT prompt_id, count(*) AS n, avg(word_count) AS m, {Z.q('word_count', .25)} AS q25, {Z.q('word_count', .5)} AS med, {Z.q('word_count', .75)} AS q75, sum(word_count) AS s FROM scored GROUP BY prompt_id),
    t AS (SELECT avg(word_count) AS gm, sum(word_count*word_count)-sum(word_count)*sum(word_count)/count(*) AS ss FROM scored)
    SELECT prompt_id, n, {r('m', 'mean')}, {r('med', 'median')}, {r('q75-q25', 'iqr')}, {r('(SELECT sum(n*(m-gm)*(m-gm)) FROM g, t)/ss', 'eta_squared')} FROM g, t"""),
)
def _h32(spark, sf):
    return rounded(P.group_spread(scored(spark, sf), "word_count", "prompt_id"))


@query(
    "h33_feature_contrast",
    _sql("signals", f"""WITH u AS ({' UNION ALL '.join(f"SELECT large, '{x}' AS feature, {x}::DOUBLE AS v FROM signals" for x in ('word_count', 'lin_v', 'lin_g', 'd_max'))}),
    a AS (SELECT feature, avg(v) FILTER (WHERE large) AS ml, avg(v) FILTER (WHERE NOT large) AS mo, var_samp(v) FILTER (WHERE large) AS vl, var_samp(v) FILTER (WHERE NOT large) AS vo,
    quantile_cont(v, 0.5) FILTER (WHERE large) AS dl, quantile_cont(v, 0.5) FILTER (WHERE NOT large) AS d0 FROM u GROUP BY feature)
    SELECT feature, {r('ml', 'mean_large')}, {r('mo', 'mean_other')}, {r('dl', 'median_large')}, {r('d0', 'median_other')}, {r('(ml-mo)/nullif(sqrt((vl+vo)/2), 0)', 'smd')} FROM a"""),
)
def _h33(spark, sf):
    return rounded(P.feature_contrast(with_signals(spark, sf), ["word_count", "lin_v", "lin_g", "d_max"], "large"))


@query(
    "h34_validation_vs_test",
    _sql("long", f"""WITH m AS (SELECT split, target, model, {Z.mae()} AS mae, {Z.rmse()} AS rmse, {Z.qwk()} AS qwk FROM long WHERE split<>'model_train' GROUP BY ALL),
    u AS (SELECT split, target, model, 'mae' AS metric, mae AS v FROM m UNION ALL SELECT split, target, model, 'rmse', rmse FROM m UNION ALL SELECT split, target, model, 'qwk', qwk FROM m)
    SELECT target, model, metric, {r("max(v) FILTER (WHERE split='validation')", 'validation')}, {r("max(v) FILTER (WHERE split='official_test')", 'official_test')},
    {r("max(v) FILTER (WHERE split='official_test')-max(v) FILTER (WHERE split='validation')", 'change')} FROM u GROUP BY ALL"""),
)
def _h34(spark, sf):
    m = E.metric_table(long_scores(spark, sf).where("split <> 'model_train'"), ["split", "target", "model"])
    return rounded(P.compare_splits(m, ["mae", "rmse", "qwk"], ["target", "model"], "validation", "official_test"))


@query("h35_trigger_counts", _sql("signals", f"SELECT split, {n_if('err_v>=1 AND err_g<1')} AS v_only, {n_if('err_v<1 AND err_g>=1')} AS g_only, {n_if('err_v>=1 AND err_g>=1')} AS both FROM signals GROUP BY split"))
def _h35(spark, sf):
    v, g = c("err_v") >= 1, c("err_g") >= 1
    return with_signals(spark, sf).groupBy("split").agg(
        F.count_if(v & ~g).alias("v_only"), F.count_if(~v & g).alias("g_only"), F.count_if(v & g).alias("both")
    )


_TBAND = "CASE WHEN truth<2.5 THEN 'y<2.5' WHEN truth<=4.0 THEN '2.5<=y<=4.0' ELSE 'y>4.0' END"


@query(
    "h36_large_errors_by_band",
    _sql("signals", f"""WITH u AS (SELECT 'V' AS target, y_v AS truth, for_v-y_v AS e, lin_v-y_v AS o, d_max FROM signals UNION ALL SELECT 'G', y_g, for_g-y_g, lin_g-y_g, d_max FROM signals)
    SELECT target, {_TBAND} AS band, count(*) AS n, {n_if('abs(e)>=1')} AS target_large, {r('avg((abs(e)>=1)::INT)', 'large_rate')}, {r('avg(d_max)', 'mean_d')}, {r('avg(e)', 'mean_signed_forest')}, {r('avg(o)', 'mean_signed_linear')} FROM u GROUP BY ALL"""),
)
def _h36(spark, sf):
    u = with_signals(spark, sf).select("d_max", F.expr("stack(2, 'V', y_v, for_v-y_v, lin_v-y_v, 'G', y_g, for_g-y_g, lin_g-y_g) AS (target, truth, e, o)"))
    hit = F.abs(c("e")) >= 1
    return rounded(u.groupBy("target", S.truth_band(c("truth")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("target_large"), F.avg(hit.cast("double")).alias("large_rate"),
        F.avg("d_max").alias("mean_d"), F.avg("e").alias("mean_signed_forest"), F.avg("o").alias("mean_signed_linear"),
    ))


@query(
    "h37_spread_summary",
    _sql("long", f"""SELECT target, model, count(*) AS n, {r('stddev_pop(truth)', 'sd_true')}, {r('stddev_pop(prediction)', 'sd_pred')}, {r('stddev_pop(prediction)/stddev_pop(truth)', 'ratio')},
    min(truth) AS true_min, max(truth) AS true_max, min(prediction) AS pred_min, max(prediction) AS pred_max, {r(Z.pearson('truth', 'prediction'), 'pearson')}, {r(Z.slope(), 'slope')},
    {r(Z.q('truth', .05), 'true_p05')}, {r(Z.q('truth', .95), 'true_p95')}, {r(Z.q('prediction', .05), 'pred_p05')}, {r(Z.q('prediction', .95), 'pred_p95')},
    {n_if('truth>=4.5 AND prediction BETWEEN 2.5 AND 4')} AS high_truth_in_middle, {n_if('truth<=2 AND prediction BETWEEN 2.5 AND 4')} AS low_truth_in_middle FROM long GROUP BY ALL"""),
)
def _h37(spark, sf):
    long = long_scores(spark, sf)
    mid = c("prediction").between(2.5, 4)
    tails = long.groupBy("target", "model").agg(
        F.count_if((c("truth") >= 4.5) & mid).alias("high_truth_in_middle"), F.count_if((c("truth") <= 2) & mid).alias("low_truth_in_middle")
    )
    return rounded(E.spread_table(long).join(tails, ["target", "model"]))


@query(
    "h38_level_confusion",
    _sql("long", f"""WITH l AS (SELECT target, model, CASE WHEN truth<=2.5 THEN 'low' WHEN truth<4 THEN 'mid' ELSE 'high' END AS truth_level, CASE WHEN prediction<=2.5 THEN 'low' WHEN prediction<4 THEN 'mid' ELSE 'high' END AS seen_level FROM long),
    lv AS (SELECT unnest(['low', 'mid', 'high']) AS x), g AS (SELECT DISTINCT target, model FROM l)
    SELECT g.target, g.model, a.x AS truth_level, b.x AS seen_level, count(l.target) AS n FROM g JOIN lv a ON true JOIN lv b ON true LEFT JOIN l ON l.target=g.target AND l.model=g.model AND l.truth_level=a.x AND l.seen_level=b.x GROUP BY ALL"""),
)
def _h38(spark, sf):
    lv = lambda x: F.when(x <= 2.5, "low").when(x < 4, "mid").otherwise("high")
    d = long_scores(spark, sf).withColumns({"truth_level": lv(c("truth")), "seen_level": lv(c("prediction"))})
    return E.confusion(d, "truth_level", "seen_level", ["low", "mid", "high"], ["target", "model"])


@query("h39_group_means", _sql("scored", f"SELECT prompt_id, segment, {r('avg(word_count)', 'mean_words')}, {r('avg(for_v)', 'mean_for_v')}, {r('avg(for_g)', 'mean_for_g')} FROM scored GROUP BY ALL"))
def _h39(spark, sf):
    return rounded(scored(spark, sf).groupBy("prompt_id", "segment").agg(
        F.avg("word_count").alias("mean_words"), F.avg("for_v").alias("mean_for_v"), F.avg("for_g").alias("mean_for_g")))


@query("h40_queue_composition", _sql("signals", f"WITH {_RANKED} SELECT count(*) AS selected_count, {n_if(chr(39).join(['prompt_id IN (', '1-URGENT', ', ', '2-HIGH', ')']))} AS from_prompts FROM ranked WHERE srank <= ceil(n_all*0.2::DOUBLE)"))
def _h40(spark, sf):
    s = scored(spark, sf).select("item_id", "word_count", "prompt_id")
    q = queue(s, ["word_count", "item_id"], 0.2).where("selected")
    return q.agg(F.count(F.lit(1)).alias("selected_count"), F.count_if(c("prompt_id").isin("1-URGENT", "2-HIGH")).alias("from_prompts"))


@query(
    "h41_cutoff_audit",
    _sql("signals", f"""WITH {_RANKED}, k AS (SELECT CAST(ceil(n_all*0.2::DOUBLE) AS BIGINT) AS queue_size, d_max AS cutoff FROM ranked WHERE rank=ceil(n_all*0.2::DOUBLE))
    SELECT queue_size, cutoff, {n_if('large')} AS positives, {n_if('large AND d_max<cutoff')} AS below, {n_if('large AND d_max=cutoff')} AS equal, {n_if('large AND d_max>cutoff')} AS above,
    least(queue_size, {n_if('large AND d_max>=cutoff')}) AS optimistic_cap, {n_if('large AND rank<=queue_size')} AS caught FROM ranked, k GROUP BY queue_size, cutoff"""),
)
def _h41(spark, sf):
    return Q.cutoff_audit(_disagreement_queue(spark, sf), "d_max")


@query(
    "h42_fold_mean_baseline",
    _sql("long", f"""WITH l AS (SELECT target, cv_fold, truth FROM long WHERE model='linear' AND cv_fold IS NOT NULL), p AS (SELECT target, cv_fold, count(*) AS n, sum(truth) AS s FROM l GROUP BY ALL),
    m AS (SELECT target, cv_fold, (sum(s) OVER (PARTITION BY target)-s)/(sum(n) OVER (PARTITION BY target)-n) AS prediction FROM p)
    SELECT l.target, {r('avg(abs(m.prediction-l.truth))', 'mae')}, {r('sqrt(avg((m.prediction-l.truth)*(m.prediction-l.truth)))', 'rmse')} FROM l JOIN m ON l.target=m.target AND l.cv_fold=m.cv_fold GROUP BY l.target"""),
)
def _h42(spark, sf):
    s = scored(spark, sf).where(c("cv_fold").isNotNull())
    rows = s.select("cv_fold", F.lit(None).cast("double").alias("prediction"), F.expr("stack(2, 'V', y_v, 'G', y_g) AS (target, truth)"))
    y, p = c("truth"), c("prediction")
    return rounded(E.fold_mean_baseline(rows).groupBy("target").agg(M.mae(y, p).alias("mae"), M.rmse(y, p).alias("rmse")))


@query(
    "h43_score_grid_counts",
    _sql("scored", f"""WITH {_TRUTHS}, g AS (SELECT t.target, 1+0.5*i AS score FROM (SELECT unnest(['V', 'G']) AS target) t, (SELECT unnest(generate_series(0, 8)) AS i) x),
    f AS (SELECT g.target, g.score::DOUBLE AS score, count(t.score) AS n FROM g LEFT JOIN t ON t.target=g.target AND t.score=g.score GROUP BY ALL) SELECT * FROM f"""),
)
def _h43(spark, sf):
    return P.score_grid(_targets(spark, sf), "score", ["V", "G"], F.lit(True))
