"""Section F: splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from marklens.functions import scalars as S
from marklens.operators import joins as J
from marklens.operators import profile as P
from marklens.operators import splits as X
from marklens.operators.order import ks_statistic
from marklens.plans.registry import query
from marklens.plans.sqltext import n_if, r, rounded
from marklens.plans.views import documents, scored, table, with_signals, with_views

c = F.col
_HASH = "sha256(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss'))"
_GROUPS = f"""d AS (SELECT doc_id, source, {_HASH} AS h FROM documents), hs AS (SELECT h, source, count(*) AS n FROM d GROUP BY ALL),
g AS (SELECT h, sum(n) AS group_size, count(*) AS strata, (SELECT s.source FROM hs s WHERE s.h=x.h ORDER BY s.n DESC, s.source LIMIT 1) AS stratum FROM hs x GROUP BY h),
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || h), h) <= ceil(count(*) OVER (PARTITION BY stratum)*0.2::DOUBLE) THEN 'validation' ELSE 'model_train' END AS split FROM g),
fo AS (SELECT h, CAST((row_number() OVER (PARTITION BY stratum ORDER BY md5('42-fold:' || h), h)-1) % 5 AS INT) AS cv_fold FROM sp WHERE split='model_train'),
mf AS (SELECT d.doc_id, d.source, d.h, sp.split, fo.cv_fold FROM d JOIN sp ON d.h=sp.h LEFT JOIN fo ON d.h=fo.h)"""


def _groups(spark, sf):
    return X.duplicate_groups(documents(spark, sf), S.text_hash(c("text")), "source")


def _assigned(spark, sf):
    d = documents(spark, sf).select("doc_id", "source", S.text_hash(c("text")).alias("h"))
    return X.assign(d, c("h"), "source", 0.2, 5, 42)


@query("f1_stratified_holdout", f"WITH {_GROUPS} SELECT h AS content_hash, CAST(group_size AS BIGINT) AS group_size, strata, stratum, split FROM sp")
def _f1(spark, sf):
    return X.holdout_groups(_groups(spark, sf), 0.2, 42)


@query("f2_holdout_audit", f"WITH {_GROUPS} SELECT split, count(*) AS groups, {n_if('group_size>1')} AS duplicate_groups, {n_if('strata>1')} AS multi_stratum_groups, CAST(sum(group_size) AS BIGINT) AS rows FROM sp GROUP BY split")
def _f2(spark, sf):
    return X.holdout_groups(_groups(spark, sf), 0.2, 42).groupBy("split").agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(c("group_size") > 1).alias("duplicate_groups"),
        F.count_if(c("strata") > 1).alias("multi_stratum_groups"), F.sum("group_size").alias("rows"),
    )


@query("f3_stratified_folds", f"WITH {_GROUPS} SELECT doc_id, split, cv_fold FROM mf")
def _f3(spark, sf):
    return _assigned(spark, sf).select("doc_id", "split", "cv_fold")


@query("f4_balanced_group_folds", with_views("scored", """WITH g AS (SELECT cluster, count(*) AS group_size FROM scored GROUP BY cluster), k AS (SELECT *, (row_number() OVER (ORDER BY group_size DESC, cluster)-1) % 10 AS t FROM g)
SELECT cluster, group_size, CAST(CASE WHEN t<5 THEN t ELSE 9-t END+1 AS INT) AS fold FROM k"""))
def _f4(spark, sf):
    return X.snake_folds(scored(spark, sf), "cluster", 5)


@query("f5_plain_folds", with_views("scored", "SELECT item_id, CAST((row_number() OVER (ORDER BY md5('42:' || item_id), item_id)-1) % 5 AS INT) AS fold FROM scored"))
def _f5(spark, sf):
    return X.plain_folds(scored(spark, sf).select("item_id"), "item_id", 5, 42)


@query("f6_manifest", f"""WITH {_GROUPS}, b AS (SELECT 'b' || CAST(item_id AS VARCHAR) AS item_id, {_HASH} AS h FROM benchmark)
SELECT 'd' || CAST(mf.doc_id AS VARCHAR) AS item_id, 'documents' AS source_partition, mf.split, mf.cv_fold, mf.source AS prompt_id, mf.h AS content_hash, CASE WHEN toxic=1 THEN 'flagged' WHEN l.doc_id IS NOT NULL THEN 'not_flagged' ELSE 'unresolved_raw_id_link' END AS privacy_review_status
FROM mf LEFT JOIN labels l ON l.doc_id=mf.doc_id UNION ALL SELECT item_id, 'benchmark', 'official_test', NULL, 'benchmark', h, 'unresolved_raw_id_link' FROM b""")
def _f6(spark, sf):
    dev = _assigned(spark, sf).drop("h")
    dev = J.with_status(dev, table(spark, sf, "labels"), "doc_id", ["toxic"])
    dev = dev.select(
        F.concat(F.lit("d"), c("doc_id").cast("string")).alias("item_id"), F.lit("documents").alias("source_partition"), "split", "cv_fold",
        c("source").alias("prompt_id"), "content_hash", "privacy_review_status",
    )
    test = table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), c("item_id").cast("string")).alias("item_id"), F.lit("benchmark").alias("source_partition"), F.lit("official_test").alias("split"),
        F.lit(None).cast("int").alias("cv_fold"), F.lit("benchmark").alias("prompt_id"), S.text_hash(c("text")).alias("content_hash"),
        F.lit("unresolved_raw_id_link").alias("privacy_review_status"),
    )
    return dev.unionByName(test).orderBy("source_partition", "split", "item_id")


_BAL = "{x} AS level, count(*) FILTER (WHERE split='model_train') AS first_count, count(*) FILTER (WHERE split='validation') AS second_count"


def _balance_sql(x: str) -> str:
    return f"""WITH k AS (SELECT {_BAL.format(x=x)} FROM scored WHERE split IN ('model_train', 'validation') GROUP BY 1), p AS (SELECT *, 100.0*first_count/sum(first_count) OVER () AS a, 100.0*second_count/sum(second_count) OVER () AS b FROM k)
    SELECT level, first_count, second_count, {r('a', 'first_percent')}, {r('b', 'second_percent')}, {r('abs(a-b)', 'gap')} FROM p"""


@query("f7_target_balance", with_views("scored", f"""WITH t AS (SELECT split, 'V' AS target, y_v AS score FROM scored UNION ALL SELECT split, 'G', y_g FROM scored), m AS (SELECT target, avg(score) FILTER (WHERE split='model_train') AS a, avg(score) FILTER (WHERE split='validation') AS b FROM t GROUP BY target),
k AS (SELECT target, score, count(*) FILTER (WHERE split='model_train') AS x, count(*) FILTER (WHERE split='validation') AS y FROM t WHERE split IN ('model_train', 'validation') GROUP BY ALL),
c AS (SELECT target, abs(sum(x) OVER (PARTITION BY target ORDER BY score)/sum(x) OVER (PARTITION BY target) - sum(y) OVER (PARTITION BY target ORDER BY score)/sum(y) OVER (PARTITION BY target)) AS g FROM k)
SELECT m.target, {r('a', 'train_mean')}, {r('b', 'validation_mean')}, {r('abs(a-b)', 'mean_difference')}, {r('max(g)', 'ks')} FROM m JOIN c ON m.target=c.target GROUP BY m.target, a, b"""))
def _f7(spark, sf):
    t = scored(spark, sf).where(c("split") != "official_test").select("split", F.expr("stack(2, 'V', y_v, 'G', y_g) AS (target, score)"))
    tr = c("split") == "model_train"
    m = t.groupBy("target").agg(F.avg(F.when(tr, c("score"))).alias("train_mean"), F.avg(F.when(~tr, c("score"))).alias("validation_mean"))
    m = m.withColumn("mean_difference", F.abs(c("train_mean") - c("validation_mean")))
    return rounded(m.join(ks_statistic(t, "score", tr, ["target"]), "target"))


@query("f7_score_balance", with_views("scored", _balance_sql("y_v")))
def _f7b(spark, sf):
    return rounded(X.level_balance(scored(spark, sf), c("y_v"), "model_train", "validation"), skip=("level",))


@query("f7_prompt_balance", with_views("scored", _balance_sql("prompt_id")))
def _f7c(spark, sf):
    return rounded(X.level_balance(scored(spark, sf), c("prompt_id"), "model_train", "validation"))


@query("f8_fold_summary", with_views("scored", f"""WITH f AS (SELECT cv_fold, count(*) AS n, count(DISTINCT prompt_id) AS g, sum(y_v) AS sv, sum(y_g) AS sg FROM scored WHERE cv_fold IS NOT NULL GROUP BY cv_fold)
SELECT cv_fold, n AS holdout_rows, g AS holdout_groups, CAST(sum(n) OVER ()-n AS BIGINT) AS fit_rows, {r('(sum(sv) OVER ()-sv)/(sum(n) OVER ()-n)', 'y_v_fit_mean')}, {r('sv/n', 'y_v_holdout_mean')}, {r('(sum(sg) OVER ()-sg)/(sum(n) OVER ()-n)', 'y_g_fit_mean')}, {r('sg/n', 'y_g_holdout_mean')} FROM f"""))
def _f8(spark, sf):
    return rounded(X.fold_summary(scored(spark, sf).where(c("cv_fold").isNotNull()), "cv_fold", "prompt_id", ["y_v", "y_g"]))


@query("f9_quota_sample", with_views("signals", """WITH t AS (SELECT *, 'short_text' AS reason, 0 AS p FROM (SELECT item_id FROM signals ORDER BY word_count, item_id LIMIT 5) UNION ALL SELECT *, 'long_text', 1 FROM (SELECT item_id FROM signals ORDER BY word_count DESC, item_id LIMIT 5)
UNION ALL SELECT *, 'high_error', 2 FROM (SELECT item_id FROM signals ORDER BY max_err DESC, item_id LIMIT 5) UNION ALL SELECT *, 'high_disagreement', 3 FROM (SELECT item_id FROM signals ORDER BY d_max DESC, item_id LIMIT 5)),
f AS (SELECT item_id, arg_min(reason, p) AS reason, min(p) AS p, '' AS k FROM t GROUP BY item_id), x AS (SELECT item_id, 'seeded_random' AS reason, 4 AS p, md5('42:' || item_id) AS k FROM signals WHERE item_id NOT IN (SELECT item_id FROM f))
SELECT item_id, reason FROM (SELECT * FROM f UNION ALL SELECT * FROM x) ORDER BY p, k, item_id LIMIT 25"""))
def _f9(spark, sf):
    rules = [
        ("short_text", ["word_count", "item_id"]), ("long_text", [F.desc("word_count"), "item_id"]),
        ("high_error", [F.desc("max_err"), "item_id"]), ("high_disagreement", [F.desc("d_max"), "item_id"]),
    ]
    return X.quota_sample(with_signals(spark, sf).select("item_id", "word_count", "max_err", "d_max"), "item_id", rules, 5, 25, 42)


@query("f10_exclusive_samples", with_views("signals", """WITH a AS (SELECT item_id, 'highest_error' AS sample FROM signals WHERE large ORDER BY max_err DESC, item_id LIMIT 12),
b AS (SELECT item_id, 'shared_blind_spot' AS sample FROM signals WHERE large AND d_max<0.25 AND item_id NOT IN (SELECT item_id FROM a) ORDER BY item_id LIMIT 10),
c AS (SELECT item_id, 'low_error_comparison' AS sample FROM signals WHERE max_err<0.5 AND item_id NOT IN (SELECT item_id FROM a UNION ALL SELECT item_id FROM b) ORDER BY max_err, item_id LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"""))
def _f10(spark, sf):
    s = with_signals(spark, sf).select("item_id", "large", "max_err", "d_max")
    return X.exclusive_samples(s, "item_id", [
        ("highest_error", c("large"), [F.desc("max_err"), "item_id"], 12),
        ("shared_blind_spot", c("large") & (c("d_max") < 0.25), ["item_id"], 10),
        ("low_error_comparison", c("max_err") < 0.5, ["max_err", "item_id"], 10),
    ]).select("item_id", "sample")


def _f11_sql() -> str:
    steps, prev = [], []
    for i, (name, t, cond, order) in enumerate(_F11):
        res = f"(for_{t}-y_{t})"
        seen = f" AND item_id NOT IN ({' UNION ALL '.join(f'SELECT item_id FROM s{j}' for j in prev)})" if prev else ""
        steps.append(f"s{i} AS (SELECT item_id, '{name}_{t}' AS sample FROM scored WHERE {cond.format(y=f'y_{t}', e=res)}{seen} ORDER BY {order.format(e=res)}, item_id LIMIT 5)")
        prev.append(i)
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in prev)


_F11 = [
    (name, t, cond, order)
    for name, cond, order in (
        ("low_score_overprediction", "{y}<=2.5 AND {e}>0", "{e} DESC"),
        ("high_score_underprediction", "{y}>=4 AND {e}<0", "{e}"),
        ("good_prediction", "true", "abs({e})"),
    )
    for t in "vg"
]


@query("f11_controlled_errors", with_views("scored", _f11_sql()))
def _f11(spark, sf):
    steps = []
    for name, t, cond, order in _F11:
        e = f"(for_{t}-y_{t})"
        key = F.expr(order.format(e=e).replace(" DESC", ""))
        steps.append((f"{name}_{t}", F.expr(cond.format(y=f"y_{t}", e=e)), [key.desc() if "DESC" in order else key.asc(), "item_id"], 5))
    return X.exclusive_samples(scored(spark, sf), "item_id", steps).select("item_id", "sample")


_BAND = "CASE WHEN y_v<2.5 THEN 'low' WHEN y_v<=4.0 THEN 'mid' ELSE 'high' END"


@query("f12_band_sample", with_views("scored", f"""WITH b AS (SELECT item_id, {_BAND} AS band, CASE WHEN prompt_id='1-URGENT' THEN '1' ELSE '0' END || md5('7:' || item_id) AS k FROM scored), s AS (SELECT item_id, band, row_number() OVER (PARTITION BY band ORDER BY k, item_id) AS rn FROM b)
SELECT item_id, band, row_number() OVER (ORDER BY md5('7-order:' || item_id), item_id) AS reading_order FROM s WHERE rn<=12"""))
def _f12(spark, sf):
    s = scored(spark, sf).select("item_id", "prompt_id", F.when(c("y_v") < 2.5, "low").when(c("y_v") <= 4.0, "mid").otherwise("high").alias("band"))
    return X.band_sample(s, "item_id", "band", 12, 7, c("prompt_id") == "1-URGENT").select("item_id", "band", "reading_order")


@query("f13_anonymous_codes", with_views("scored", f"""WITH b AS (SELECT item_id, {_BAND} AS band, '0' || md5('9:' || item_id) AS k FROM scored), s AS (SELECT item_id, band, row_number() OVER (PARTITION BY band ORDER BY k, item_id) AS rn FROM b)
SELECT item_id, band, 'r2_' || lpad(CAST(row_number() OVER (ORDER BY md5('9-order:' || item_id), item_id) AS VARCHAR), 2, '0') AS code FROM s WHERE rn<=2"""))
def _f13(spark, sf):
    s = scored(spark, sf).select("item_id", F.when(c("y_v") < 2.5, "low").when(c("y_v") <= 4.0, "mid").otherwise("high").alias("band"))
    return X.band_sample(s, "item_id", "band", 2, 9).select("item_id", "band", X.anonymous_code("r2", c("reading_order")).alias("code"))


@query("f14_rare_extremes", with_views("scored", "SELECT item_id, y_v, y_g FROM scored WHERE y_v<=1.5 OR y_g<=1.5 OR y_v>=4.5 OR y_g>=4.5"))
def _f14(spark, sf):
    extreme = (F.least("y_v", "y_g") <= 1.5) | (F.greatest("y_v", "y_g") >= 4.5)
    return scored(spark, sf).where(extreme).select("item_id", "y_v", "y_g")


@query("f15_median_nearest", with_views("scored", "WITH m AS (SELECT quantile_cont(word_count, 0.5) AS median FROM scored) SELECT item_id, word_count, median, abs(word_count-median) AS gap FROM scored, m ORDER BY gap, item_id LIMIT 1"))
def _f15(spark, sf):
    return X.nearest_to_median(scored(spark, sf).select("item_id", "word_count"), "item_id", "word_count")


@query("f16_shortlists", with_views("signals", "SELECT * FROM (SELECT item_id, 'large_low_d' AS shortlist FROM signals WHERE large ORDER BY d_max, item_id LIMIT 10) UNION ALL SELECT * FROM (SELECT item_id, 'small_high_d' FROM signals WHERE NOT large ORDER BY d_max DESC, item_id LIMIT 10)"))
def _f16(spark, sf):
    s = with_signals(spark, sf).select("item_id", "large", "d_max")
    a = X.first_rows(s.where("large"), ["d_max", "item_id"], 10).select("item_id", F.lit("large_low_d").alias("shortlist"))
    b = X.first_rows(s.where("NOT large"), [F.desc("d_max"), "item_id"], 10).select("item_id", F.lit("small_high_d").alias("shortlist"))
    return a.unionByName(b)
