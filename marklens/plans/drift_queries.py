"""Sections J and M: drift, correlation and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from marklens.functions import metrics as M
from marklens.functions import scalars as S
from marklens.operators import agreement as A
from marklens.operators import drift as D
from marklens.operators import groups as G
from marklens.operators import queues as Q
from marklens.operators.order import auroc, average_ranks, ks_statistic, spearman
from marklens.plans import sqltext as Z
from marklens.plans.registry import query
from marklens.plans.sqltext import n_if, r, rounded
from marklens.plans.views import ratings, scored, table, with_signals, with_views

c = F.col
_F = ("word_count", "lin_v", "for_v", "lin_g", "for_g")
_ROWS = "fr AS (" + " UNION ALL ".join(f"SELECT split, '{x}' AS feature, {x}::DOUBLE AS v FROM scored" for x in _F) + ")"
_TR, _OT = "split='model_train'", "split<>'model_train'"


def _fit():
    return c("split") == "model_train", c("split") != "model_train"


def _rows(spark, sf):
    return D.feature_rows(scored(spark, sf), _F)


def _base(spark, sf):
    return D.value_counts(_rows(spark, sf), *_fit())


def _f(agg: str, cond: str) -> str:
    return f"{agg} FILTER (WHERE {cond})"


@query("j1_feature_quality", with_views("scored", f"""WITH {_ROWS}, q AS (SELECT feature, {_f('quantile_cont(v, 0.01)', _TR)} AS p01, {_f('quantile_cont(v, 0.25)', _TR)} AS q1, {_f('quantile_cont(v, 0.5)', _TR)} AS median,
{_f('quantile_cont(v, 0.75)', _TR)} AS q3, {_f('quantile_cont(v, 0.99)', _TR)} AS p99 FROM fr GROUP BY feature),
d AS (SELECT feature, count(*) AS train_unique, max(n)/sum(n) AS dominant_share FROM (SELECT feature, v, count(*) AS n FROM fr WHERE {_TR} GROUP BY ALL) GROUP BY feature),
b AS (SELECT feature, {n_if(_TR + ' AND v IS NULL')} AS train_missing, {n_if(_OT + ' AND v IS NULL')} AS other_missing, {n_if(_TR + ' AND isinf(v)')} AS train_infinite, {n_if(_OT + ' AND isinf(v)')} AS other_infinite,
{n_if(_TR)} AS train_n, {n_if(_OT)} AS other_n, {_f('min(v)', _TR)} AS train_min, {_f('max(v)', _TR)} AS train_max, {_f('avg(v)', _TR)} AS train_mean, {_f('stddev_samp(v)', _TR)} AS train_std FROM fr GROUP BY feature),
o AS (SELECT fr.feature, {n_if(_TR + ' AND (v<q1-1.5*(q3-q1) OR v>q3+1.5*(q3-q1))')} AS train_outliers, {n_if(_OT + ' AND (v<q1-1.5*(q3-q1) OR v>q3+1.5*(q3-q1))')} AS other_outliers FROM fr JOIN q ON fr.feature=q.feature GROUP BY fr.feature)
SELECT b.feature, train_missing, other_missing, train_infinite, other_infinite, train_n, other_n, train_min, train_max, {r('train_mean', 'train_mean')}, {r('train_std', 'train_std', 6)}, train_unique, {r('dominant_share', 'dominant_share')},
{r('p01', 'p01')}, {r('q1', 'q1')}, {r('median', 'median')}, {r('q3', 'q3')}, {r('p99', 'p99')}, {r('q1-1.5*(q3-q1)', 'lower_fence')}, {r('q3+1.5*(q3-q1)', 'upper_fence')}, train_outliers, other_outliers,
{r('train_outliers/train_n', 'train_outlier_share')}, {r('other_outliers/other_n', 'other_outlier_share')}, train_std<=1e-8 OR dominant_share>=0.95 AS near_constant FROM b JOIN d ON b.feature=d.feature JOIN q ON b.feature=q.feature JOIN o ON b.feature=o.feature"""))
def _j1(spark, sf):
    out = D.feature_quality(_base(spark, sf))
    return rounded(out.withColumn("train_std", F.round("train_std", 6)))


_MD = f"""md AS (SELECT feature, {_f('avg(v)', _TR)} AS m1, {_f('avg(v)', _OT)} AS m2, {_f('stddev_samp(v)', _TR)} AS s1, {_f('stddev_samp(v)', _OT)} AS s2 FROM fr GROUP BY feature)"""
_MD_COLS = f"{r('m1', 'train_mean')}, {r('m2', 'other_mean')}, {r('s1', 'train_std', 6)}, {r('s2', 'other_std', 6)}, {r('coalesce((m2-m1)/nullif(sqrt((s1*s1+s2*s2)/2), 0), 0)', 'smd')}"


def _trim(df):
    return rounded(df.withColumns({"train_std": F.round("train_std", 6), "other_std": F.round("other_std", 6)}))


@query("j2_mean_differences", with_views("scored", f"WITH {_ROWS}, {_MD} SELECT feature, {_MD_COLS} FROM md"))
def _j2(spark, sf):
    return _trim(D.mean_differences(_base(spark, sf)))


_PSI = f"""ed AS (SELECT feature, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM fr WHERE {_TR} GROUP BY feature), de AS (SELECT DISTINCT feature, unnest(e) AS edge FROM ed),
pl AS (SELECT fr.feature, split, (SELECT count(*) FROM de WHERE de.feature=fr.feature AND fr.v>=de.edge) AS bin FROM fr),
gr AS (SELECT feature, unnest(generate_series(0, count(*)))::BIGINT AS bin FROM de GROUP BY feature),
ct AS (SELECT gr.feature, gr.bin, {n_if(_TR)} AS a, {n_if(_OT)} AS b FROM gr LEFT JOIN pl ON pl.feature=gr.feature AND pl.bin=gr.bin GROUP BY gr.feature, gr.bin),
sh AS (SELECT feature, greatest(a/sum(a) OVER (PARTITION BY feature), 1e-6) AS p, greatest(b/sum(b) OVER (PARTITION BY feature), 1e-6) AS q FROM ct),
psi AS (SELECT feature, sum((q-p)*ln(q/p)) AS psi FROM sh GROUP BY feature)"""
_KS = f"""kv AS (SELECT feature, v, {n_if(_TR)} AS a, {n_if(_OT)} AS b FROM fr GROUP BY feature, v), kr AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY feature) AS ta, sum(b) OVER (PARTITION BY feature) AS tb
FROM kv WINDOW w AS (PARTITION BY feature ORDER BY v)), ks AS (SELECT feature, max(abs(ca/ta-cb/tb)) AS ks FROM kr GROUP BY feature)"""


@query("j3_stability_index", with_views("scored", f"WITH {_ROWS}, {_PSI} SELECT feature, {r('psi', 'psi')} FROM psi"))
def _j3(spark, sf):
    return rounded(D.stability_index(_base(spark, sf)))


@query("j4_ks_statistic", with_views("scored", f"WITH {_ROWS}, {_KS} SELECT feature, {r('ks', 'ks')} FROM ks"))
def _j4(spark, sf):
    return rounded(ks_statistic(_rows(spark, sf), "value", _fit()[0], ["feature"]))


@query("j5_stability_verdict", with_views("scored", f"WITH {_ROWS}, {_MD}, {_PSI}, {_KS} SELECT md.feature, {_MD_COLS}, {r('ks', 'ks')}, {r('psi', 'psi')}, abs(coalesce((m2-m1)/nullif(sqrt((s1*s1+s2*s2)/2), 0), 0))<=0.2 AND psi<=0.1 AND ks<=0.1 AS stable FROM md JOIN psi ON md.feature=psi.feature JOIN ks ON md.feature=ks.feature"))
def _j5(spark, sf):
    return _trim(D.stability_verdict(_base(spark, sf)))


_RK = "(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1)/2)"


@query("j6_correlation_pairs", with_views("scored", f"""WITH k AS (SELECT {', '.join(f"{x}, {_RK.format(x=x)} AS r_{x}" for x in _F)} FROM scored), p AS (
{' UNION ALL '.join(f"SELECT '{a}' AS feature_left, '{b}' AS feature_right, corr({a}, {b}) AS p, corr(r_{a}, r_{b}) AS s FROM k" for i, a in enumerate(_F) for b in _F[i + 1:])})
SELECT feature_left, feature_right, {r('p', 'pearson')}, {r('s', 'spearman')}, abs(p)>=0.95 OR abs(s)>=0.95 AS high_similarity FROM p"""))
def _j6(spark, sf):
    return rounded(D.correlation_pairs(scored(spark, sf), "item_id", _F))


@query("j7_weighted_correlation", with_views("signals", f"""WITH w AS (SELECT segment, word_count AS w, d_max AS x, max_err AS y FROM signals) SELECT segment, {r(Z.pearson('x', 'y'), 'pearson')},
{r('(sum(w*x*y)-sum(w*x)*sum(w*y)/sum(w))/sqrt((sum(w*x*x)-sum(w*x)*sum(w*x)/sum(w))*(sum(w*y*y)-sum(w*y)*sum(w*y)/sum(w)))', 'weighted_pearson')} FROM w GROUP BY segment"""))
def _j7(spark, sf):
    x, y = c("d_max"), c("max_err")
    return rounded(with_signals(spark, sf).groupBy("segment").agg(
        M.pearson(x, y).alias("pearson"), M.pearson(x, y, c("word_count")).alias("weighted_pearson")))


def _rank_in(x: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1)/2)"


@query("j8_spearman", with_views("signals", f"""WITH p AS (SELECT 'd_error' AS pair, d_max AS x, max_err AS y FROM signals UNION ALL SELECT 'd_words', d_max, word_count FROM signals UNION ALL SELECT 'd_truth_distance', d_max, abs(y_v-3) FROM signals),
k AS (SELECT pair, {_rank_in('x', 'pair')} AS a, {_rank_in('y', 'pair')} AS b FROM p) SELECT pair, count(*) AS n, {r('corr(a, b)', 'spearman')} FROM k GROUP BY pair"""))
def _j8(spark, sf):
    pairs = F.inline(F.array(*[
        F.struct(F.lit(n).alias("pair"), c("d_max").alias("x"), y.alias("y"))
        for n, y in (("d_error", c("max_err")), ("d_words", c("word_count")), ("d_truth_distance", F.abs(c("y_v") - 3)))
    ]))
    return rounded(spearman(with_signals(spark, sf).select(pairs), "x", "y", ["pair"]))


@query("j9_weighted_ranks", with_views("signals", """WITH v AS (SELECT d_max, sum(r1_v) AS w FROM signals GROUP BY d_max) SELECT d_max, CAST(w AS BIGINT) AS n, CAST(sum(w) OVER (ORDER BY d_max) - w/2 + 0.5 AS DOUBLE) AS avg_rank FROM v"""))
def _j9(spark, sf):
    return average_ranks(with_signals(spark, sf), "d_max", weight="r1_v").select("d_max", "n", "avg_rank")


def _auc_sql(by: str, source: str) -> str:
    return f"""WITH v AS (SELECT {by}, score, {n_if('large')} AS pos, {n_if('NOT large')} AS neg FROM {source} GROUP BY ALL), cu AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY score) AS cn FROM v)
    SELECT {by}, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, round(sum(pos*(cn-neg/2))/nullif(sum(pos)::DOUBLE*sum(neg), 0), 9) AS auroc FROM cu GROUP BY {by}"""


@query("j10_auroc", with_views("signals", _auc_sql("signal", "(SELECT 'disagreement' AS signal, d_max AS score, large FROM signals UNION ALL SELECT 'negative_words', -word_count, large FROM signals UNION ALL SELECT 'mean_disagreement', d_mean, large FROM signals)")))
def _j10(spark, sf):
    rows = Q.strategy_scores(
        with_signals(spark, sf), {"disagreement": c("d_max"), "negative_words": -c("word_count"), "mean_disagreement": c("d_mean")}, ["large"]
    ).withColumnRenamed("strategy", "signal")
    return rounded(auroc(rows, "score", "large", ["signal"]))


_TBAND = "CASE WHEN y_v<2.5 THEN 'y<2.5' WHEN y_v<=4.0 THEN '2.5<=y<=4.0' ELSE 'y>4.0' END"


@query("j11_auroc_in_bands", with_views("signals", _auc_sql("band", f"(SELECT {_TBAND} AS band, abs(lin_v-3) AS score, large FROM signals)")))
def _j11(spark, sf):
    s = with_signals(spark, sf).select(S.truth_band(c("y_v")).alias("band"), F.abs(c("lin_v") - 3).alias("score"), "large")
    return rounded(auroc(s, "score", "large", ["band"]))


@query("j12_quadrant_shares", with_views("signals", f"""WITH m AS (SELECT quantile_cont(d_max, 0.5) AS m FROM signals), g AS (SELECT large, CASE WHEN d_max<m THEN 'below' ELSE 'at_or_above' END AS d_group FROM signals, m), k AS (SELECT large, d_group, count(*) AS n FROM g GROUP BY ALL)
SELECT large, d_group, n, CAST(sum(n) OVER (PARTITION BY large) AS BIGINT) AS row_total, {r('n/sum(n) OVER (PARTITION BY large)', 'fraction')} FROM k"""))
def _j12(spark, sf):
    return rounded(Q.quadrant_shares(with_signals(spark, sf)))


@query("j13_band_line", with_views("scored", f"""WITH d AS (SELECT for_v-y_v AS y, lin_v-for_v AS x, {_TBAND} AS band FROM scored), w AS (SELECT x-avg(x) OVER (PARTITION BY band) AS xw, y-avg(y) OVER (PARTITION BY band) AS yw, x, y FROM d),
t AS (SELECT count(*) AS n, regr_slope(y, x) AS b1, regr_r2(y, x) AS r1, sum(xw*yw)/sum(xw*xw) AS b3, 1-sum(yw*yw)/(var_pop(y)*count(*)) AS r2, 1-(sum(yw*yw)-sum(xw*yw)*sum(xw*yw)/sum(xw*xw))/(var_pop(y)*count(*)) AS r3 FROM w)
SELECT 'x_only' AS model, n, {r('b1', 'slope')}, {r('r1', 'r2')} FROM t UNION ALL SELECT 'band_only', n, NULL, {r('r2', 'r2')} FROM t UNION ALL SELECT 'band_plus_x', n, {r('b3', 'slope')}, {r('r3', 'r2')} FROM t"""))
def _j13(spark, sf):
    return rounded(D.band_line(scored(spark, sf), c("for_v") - c("y_v"), c("lin_v") - c("for_v"), S.truth_band(c("y_v"))))


# ---- agreement ----------------------------------------------------------------------------------

_ICC = (
    "((((sum(r1*r1)+sum(r2*r2)+2*sum(r1*r2))/2-(sum(r1)+sum(r2))*(sum(r1)+sum(r2))/(2*count(*)))/(count(*)-1)) - (((sum(r1*r1)+sum(r2*r2)-2*sum(r1*r2))/2-(sum(r1)-sum(r2))*(sum(r1)-sum(r2))/(2*count(*)))/(count(*)-1)))"
    "/nullif((((sum(r1*r1)+sum(r2*r2)+2*sum(r1*r2))/2-(sum(r1)+sum(r2))*(sum(r1)+sum(r2))/(2*count(*)))/(count(*)-1)) + (((sum(r1*r1)+sum(r2*r2)-2*sum(r1*r2))/2-(sum(r1)-sum(r2))*(sum(r1)-sum(r2))/(2*count(*)))/(count(*)-1))"
    " + 2*((sum(r1)-sum(r2))*(sum(r1)-sum(r2))/(2*count(*)) - (((sum(r1*r1)+sum(r2*r2)-2*sum(r1*r2))/2-(sum(r1)-sum(r2))*(sum(r1)-sum(r2))/(2*count(*)))/(count(*)-1)))/count(*), 0)"
)
_AG = (
    f"count(*) AS n, {r('avg(abs(r1-r2))', 'mae')}, {r('avg((r1=r2)::INT)', 'exact')}, {r('avg((abs(r1-r2)<=0.5)::INT)', 'within_half')}, {r('avg((abs(r1-r2)<=1)::INT)', 'within_one')}, "
    f"{r(Z.kappa('r1', 'r2'), 'qwk')}, {r(_ICC, 'icc')}"
)


@query("m1_pair_agreement", with_views("ratings", f"SELECT target, {_AG} FROM ratings GROUP BY target"))
def _m1(spark, sf):
    return rounded(A.pair_agreement(ratings(spark, sf), ["target"]))


@query("m2_icc", with_views("ratings", f"SELECT target, prompt_id, {r(_ICC, 'icc')} FROM ratings GROUP BY ALL"))
def _m2(spark, sf):
    return rounded(ratings(spark, sf).groupBy("target", "prompt_id").agg(M.icc_agreement(c("r1"), c("r2")).alias("icc")))


@query("m3_model_and_raters", with_views("ratings", f"""SELECT target, {_AG}, {r('avg(abs(prediction-human))', 'model_aggregate_mae')}, {r('(avg(abs(prediction-r1))+avg(abs(prediction-r2)))/2', 'model_individual_mae')},
{r('avg((abs(human-(r1+r2)/2)<=1e-12)::INT)', 'aggregate_is_mean_rate')} FROM ratings GROUP BY target"""))
def _m3(spark, sf):
    return rounded(A.model_and_raters(ratings(spark, sf), ["target"]))


@query("m4_subgroup_agreement", with_views("ratings", f"""WITH b AS (SELECT *, CASE WHEN y_v<=2.5 THEN 'low' WHEN y_v<=3.5 THEN 'middle' ELSE 'high' END AS band FROM ratings),
u AS (SELECT target, 'split' AS group_type, split AS group_value, r1, r2 FROM b UNION ALL SELECT target, 'prompt_id', prompt_id, r1, r2 FROM b UNION ALL SELECT target, 'band', band, r1, r2 FROM b)
SELECT target, group_type, group_value, {_AG} FROM u GROUP BY ALL HAVING count(*)>=20"""))
def _m4(spark, sf):
    rows = ratings(spark, sf).withColumn("band", S.score_band(c("y_v")))
    return rounded(A.subgroup_agreement(rows, ["split", "prompt_id", "band"], 20))


@query("m5_disagreement_vs_error", with_views("ratings", f"""WITH e AS (SELECT target, abs(r1-r2) AS gap, abs(prediction-human) AS err FROM ratings), k AS (SELECT *, {_rank_in('gap', 'target')} AS a, {_rank_in('err', 'target')} AS b FROM e),
p AS (SELECT target, quantile_cont(err, 0.9) AS p90 FROM e GROUP BY target)
SELECT k.target, count(*) AS n, {r('corr(a, b)', 'spearman')}, {r('avg(err) FILTER (WHERE gap=0)', 'error_if_agree')}, {r('avg(err) FILTER (WHERE gap>0)', 'error_if_disagree')}, {r('avg((gap>0)::INT) FILTER (WHERE err>=p90)', 'disagree_rate_in_top_decile')} FROM k JOIN p ON k.target=p.target GROUP BY k.target"""))
def _m5(spark, sf):
    return rounded(A.disagreement_vs_error(ratings(spark, sf)))


@query("m6_rater_gaps", with_views("ratings", f"SELECT target, {n_if('abs(r1-r2)=1')} AS gap_one, {n_if('abs(r1-r2)>=1')} AS gap_at_least_one, {n_if('abs(r1-r2)>1')} AS gap_over_one FROM ratings GROUP BY target"))
def _m6(spark, sf):
    g = F.abs(c("r1") - c("r2"))
    return ratings(spark, sf).groupBy("target").agg(
        F.count_if(g == 1).alias("gap_one"), F.count_if(g >= 1).alias("gap_at_least_one"), F.count_if(g > 1).alias("gap_over_one"))


_TOOLS = f"""u AS (SELECT segment, 'for_v' AS tool, for_v::DOUBLE AS value, r1_v::DOUBLE AS reader FROM scored UNION ALL SELECT segment, 'lin_v', lin_v, r1_v FROM scored UNION ALL SELECT segment, 'r2_v', r2_v, r1_v FROM scored),
g AS (SELECT segment AS scope, tool, value, reader FROM u UNION ALL SELECT 'pooled', tool, value, reader FROM u),
k AS (SELECT *, (rank() OVER (PARTITION BY scope, tool ORDER BY value) + (count(*) OVER (PARTITION BY scope, tool, value) - 1)/2) AS a, (rank() OVER (PARTITION BY scope, tool ORDER BY reader) + (count(*) OVER (PARTITION BY scope, tool, reader) - 1)/2) AS b FROM g),
ta AS (SELECT scope, tool, count(*) AS n, corr(a, b) AS sp, avg(value) AS tm, avg(reader) AS rm, avg(abs(value-reader)) AS mae FROM k GROUP BY ALL)"""


def _tools(spark, sf):
    return A.tool_agreement(scored(spark, sf), "r1_v", ["for_v", "lin_v", "r2_v"], "segment")


@query("m7_tool_agreement", with_views("scored", f"WITH {_TOOLS} SELECT scope, tool, n, {r('sp', 'spearman')}, {r('tm', 'tool_mean')}, {r('rm', 'reader_mean')}, {r('tm-rm', 'signed_bias')}, {r('abs(tm-rm)', 'absolute_bias')}, {r('mae', 'mae')} FROM ta"))
def _m7(spark, sf):
    return rounded(_tools(spark, sf))


@query("m8_tool_verdict", with_views("scored", f"""WITH {_TOOLS}, x AS (SELECT max(sp) FILTER (WHERE tool='r2_v') > max(sp) FILTER (WHERE tool='lin_v') AS a, max(abs(tm-rm)) FILTER (WHERE tool='r2_v') < max(abs(tm-rm)) FILTER (WHERE tool='lin_v') AS b FROM ta WHERE scope='pooled')
SELECT a AS higher_spearman, b AS smaller_gap, a AND b AS accepted FROM x"""))
def _m8(spark, sf):
    return A.tool_verdict(_tools(spark, sf), "r2_v", "lin_v")


@query("m9_reader_counts", with_views("ratings", f"""WITH k AS (SELECT target, r1, r2, {_rank_in('r1', 'target')} AS a, {_rank_in('r2', 'target')} AS b FROM ratings)
SELECT target, count(*) AS n, {r('corr(a, b)', 'spearman')}, sum(abs(r2-r1))::DOUBLE AS sum_absolute, {r('avg(abs(r2-r1))', 'mean_absolute')}, {r('avg(r2-r1)', 'bias')}, {n_if('abs(r2-r1)>=2')} AS two_or_more, {r('corr(r1, r2)', 'pearson')} FROM k GROUP BY target"""))
def _m9(spark, sf):
    return rounded(A.reader_counts(ratings(spark, sf), "r1", "r2", ["target"]))


_CAUSES = " UNION ALL ".join(f"SELECT '{x}' AS reader, {x} AS cause FROM scored" for x in ("r1_v", "r2_v"))


@query("m10_cause_counts", with_views("scored", f"""WITH u AS ({_CAUSES}), st AS (SELECT reader, CASE WHEN count(cause)=0 THEN 'not_started' WHEN count(cause)<count(*) THEN 'incomplete' ELSE 'complete' END AS state FROM u GROUP BY reader)
SELECT st.reader, st.state, c.cause, count(u.cause) AS n FROM st JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS cause) c ON true LEFT JOIN u ON u.reader=st.reader AND u.cause=c.cause GROUP BY ALL"""))
def _m10(spark, sf):
    return A.cause_counts(scored(spark, sf), ["r1_v", "r2_v"], range(1, 7))


@query("m10_cause_agreement", with_views("scored", f"SELECT count(*) AS n, {n_if('r1_v=r2_v')} AS same, {r('avg((r1_v=r2_v)::INT)', 'rate')}, {n_if('r1_v=5 OR r2_v=5')} AS flagged_by_either FROM scored"))
def _m10b(spark, sf):
    return rounded(A.cause_agreement(scored(spark, sf), "r1_v", "r2_v", 5))


@query("m11_label_sets", with_views("scored", """SELECT item_id, CASE WHEN list_sort(list_distinct([r1_v, r1_g]))=list_sort(list_distinct([r2_v, r2_g])) THEN 'same' WHEN r1_v IN (r2_v, r2_g) OR r1_g IN (r2_v, r2_g) THEN 'partial' ELSE 'different' END AS relation FROM scored"""))
def _m11(spark, sf):
    return scored(spark, sf).select("item_id", A.label_set_relation(F.array("r1_v", "r1_g"), F.array("r2_v", "r2_g")).alias("relation"))


@query("m12_reader_summary", with_views("scored", f"""WITH b AS (SELECT {_TBAND} AS band, segment, r1_v::DOUBLE AS reader, for_v*least(150, word_count)/100 AS tool FROM scored), k AS (SELECT *, {_rank_in('reader', 'band, segment')} AS a, {_rank_in('tool', 'band, segment')} AS b FROM b)
SELECT band, segment, count(*) AS n, {r('corr(a, b)', 'spearman')}, {r('avg(reader)', 'mean_reader')}, {r('avg(tool)', 'mean_tool')}, {r('avg(reader-tool)', 'mean_gap')}, {n_if('tool<0.5')} AS tool_below, {r('quantile_cont(reader, 0.5)', 'median_reader')} FROM k GROUP BY band, segment"""))
def _m12(spark, sf):
    d = scored(spark, sf).select(
        S.truth_band(c("y_v")).alias("band"), "segment", c("r1_v").cast("double").alias("reader"),
        S.windowed_estimate(c("for_v"), c("word_count")).alias("tool"),
    )
    return rounded(A.reader_summary(d, ["band", "segment"]))
