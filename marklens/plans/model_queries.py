"""Section L and A12: models over the scored items, documents and embeddings."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marklens.operators import chance as X
from marklens.operators import evaluation as E
from marklens.operators import forests as R
from marklens.operators import linear as N
from marklens.operators import models as L
from marklens.operators.order import auroc, queue, with_row
from marklens.plans import sqltext as Z
from marklens.plans.forest_sql import forest_ctes, predictions
from marklens.plans.linear_sql import line_sql, ridge_ctes
from marklens.plans.registry import query
from marklens.plans.sqltext import r, rounded
from marklens.plans.views import scored, table, with_signals, with_views
from marklens.session import materialise, scratch_dir

c = F.col
FEATURES = ["word_count", "lin_v", "lin_g", "for_g"]
TARGETS = {"v": "y_v", "g": "y_g"}
FOLDS = range(5)
#: Fixed strengths and forest parameters of the searches.
ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)
CHOSEN = {"v": 100.0, "g": 0.1}
TREES, DEPTH, LEAF = 300, 10, 2


def _items(spark, sf):
    """The model table, written once: every fit reads it again."""
    cols = ["item_id", "item_no", "split", "cv_fold", "cluster", "y_v", "y_g", *FEATURES, "for_v", "r1_v", "r2_v", "r1_g", "r2_g"]
    return materialise(scored(spark, sf).select(*dict.fromkeys(cols)), "items")


def _train(items):
    return items.where("split = 'model_train'")


def _forest(name, target, features=FEATURES, **options):
    return R.Spec(name, target, tuple(features), TREES, **({"depth": DEPTH, "leaf": LEAF, "tried": R.sqrt_features(features)} | options))


_TRAIN = "split='model_train'"
_ALL_FITS = {t: (y, _TRAIN, "true") for t, y in TARGETS.items()}


def _trees_sql(fits, features=FEATURES):
    return forest_ctes("scored", fits, features, R.sqrt_features(features), TREES, DEPTH, LEAF)


_SOLVE = """st AS (SELECT count(*) AS n, avg(word_count) AS m1, stddev_pop(word_count) AS s1, avg(lin_v) AS m2, stddev_pop(lin_v) AS s2, avg(y_v) AS my FROM scored WHERE split='model_train'),
z AS (SELECT (word_count-m1)/s1 AS a, (lin_v-m2)/s2 AS b, y_v-my AS y FROM scored, st WHERE split='model_train'), g AS (SELECT sum(a*a)+100 AS aa, sum(a*b) AS ab, sum(b*b)+100 AS bb, sum(a*y) AS ay, sum(b*y) AS by_ FROM z),
w AS (SELECT (bb*ay-ab*by_)/(aa*bb-ab*ab) AS w1, (aa*by_-ab*ay)/(aa*bb-ab*ab) AS w2 FROM g)"""


@query("l1_ridge", with_views("scored", f"WITH {_SOLVE} SELECT item_id, round(my + w1*(word_count-m1)/s1 + w2*(lin_v-m2)/s2, 7) AS prediction FROM scored, st, w"))
def _l1(spark, sf):
    items = _items(spark, sf)
    model = L.ridge(["word_count", "lin_v"], "y_v", 100.0)(_train(items))
    return rounded(model.transform(items).select("item_id", "prediction"), 7)


@query("l2_forest", with_views("scored", f"WITH {_trees_sql({'v': _ALL_FITS['v']})}, {predictions()} SELECT item_id, round(p, 7) AS prediction FROM pr JOIN scored ON item_no = key"))
def _l2(spark, sf):
    items = _items(spark, sf)
    out = R.predict(items, R.grow(_train(items), [_forest("v", "y_v")]), {"prediction": "v"})
    return rounded(out.select("item_id", "prediction"), 7)


def _four(items):
    """Linear and forest predictions of both targets, and the models."""
    train = _train(items)
    sums = N.gram(train, FEATURES, list(TARGETS.values()))
    lines = {t: N.solve(sums, y, CHOSEN[t]) for t, y in TARGETS.items()}
    forests = R.grow(train, [_forest(t, y) for t, y in TARGETS.items()])
    out = items
    for t, line in lines.items():
        out = line.transform(out, f"linear_{t}")
    return R.predict(out, forests, {f"forest_{t}": t for t in TARGETS}), lines, forests


_LINES = ridge_ctes("scored", {t: (y, _TRAIN) for t, y in TARGETS.items()}, FEATURES, tag="_r")
_FOUR = f"""WITH RECURSIVE al AS (SELECT unnest([0.1, 100.0])::DOUBLE AS alpha), {_LINES}, {_trees_sql(_ALL_FITS)}, {predictions()},
pv AS (SELECT s.*, {line_sql(FEATURES)} AS linear_v FROM scored s, lin_r WHERE fit = 'v' AND alpha = 100.0), pg AS (SELECT item_no AS key, {line_sql(FEATURES)} AS linear_g FROM scored, lin_r WHERE fit = 'g' AND alpha = 0.1),
fo AS (SELECT key, max(p) FILTER (WHERE fit = 'v') AS forest_v, max(p) FILTER (WHERE fit = 'g') AS forest_g FROM pr GROUP BY key), four AS (SELECT * FROM pv JOIN pg ON pg.key = item_no JOIN fo ON fo.key = item_no)"""


@query("l3_model_set", with_views("scored", f"""{_FOUR}, lo AS (SELECT 'V' AS target, 'linear' AS model, y_v AS truth, linear_v AS p FROM four UNION ALL SELECT 'V', 'forest', y_v, forest_v FROM four UNION ALL SELECT 'G', 'linear', y_g, linear_g FROM four UNION ALL SELECT 'G', 'forest', y_g, forest_g FROM four)
SELECT target, model, count(*) AS n, round(avg(abs(p-truth)), 6) AS mae FROM lo GROUP BY ALL"""))
def _l3(spark, sf):
    out = _four(_items(spark, sf))[0]
    return out.select(F.expr("stack(4, 'V','linear',y_v,linear_v, 'V','forest',y_v,forest_v, 'G','linear',y_g,linear_g, 'G','forest',y_g,forest_g) AS (target, model, truth, prediction)")).groupBy("target", "model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(c("prediction") - c("truth"))), 6).alias("mae"))


_FOLD_FITS = {f"{t}{f}": (y, f"cv_fold<>{f}") for t, y in TARGETS.items() for f in FOLDS}


@query("l4_grid_search", with_views("scored", f"""WITH RECURSIVE al AS (SELECT unnest({list(ALPHAS)})::DOUBLE AS alpha), {ridge_ctes('scored', _FOLD_FITS, FEATURES)},
o AS (SELECT upper(t) AS target, alpha, cv_fold AS fold, {line_sql(FEATURES)} AS p, CASE WHEN t = 'v' THEN y_v ELSE y_g END AS y FROM scored, (SELECT unnest(['v', 'g']) AS t) JOIN lin ON fit = t || cv_fold),
m AS (SELECT target, alpha, fold, avg(abs(p-y)) AS mae FROM o GROUP BY ALL), a AS (SELECT target, alpha, round(avg(mae), 12) AS mean FROM m GROUP BY ALL)
SELECT target, alpha, fold, round(mae, 9) AS mae, alpha = (SELECT alpha FROM a b WHERE b.target = m.target ORDER BY mean, alpha LIMIT 1) AS selected FROM m"""))
def _l4(spark, sf):
    train = _train(_items(spark, sf))
    sums = N.gram(train, FEATURES, list(TARGETS.values()), "cv_fold")
    rows = []
    for t, y in TARGETS.items():
        found, best = N.grid(train, sums, y, ALPHAS, FOLDS)
        chosen = found.groupby("alpha", sort=False)["mae"].mean().round(12).idxmin()
        rows += [(t.upper(), r.alpha, int(r.fold), r.mae, bool(r.alpha == chosen)) for r in found.itertuples()]
    return rounded(spark.createDataFrame(rows, "target string, alpha double, fold int, mae double, selected boolean"), skip=("alpha",))


@query("l4_forest_grid")
def _l4b(spark, sf):
    """Two depths, two leaf sizes, two feature counts; both targets; every fold."""
    train = _train(_items(spark, sf))
    grid = [(d, leaf, m) for d in (DEPTH, None) for leaf in (2, 5) for m in (R.sqrt_features(FEATURES), len(FEATURES))]
    names = {f"{t}|depth={d} leaf={leaf} tried={m}": (t, d, leaf, m) for t in TARGETS for d, leaf, m in grid}
    specs = [s for n, (t, d, leaf, m) in names.items() for s in R.folds_of(_forest(n, TARGETS[t], depth=d, leaf=leaf, tried=m), FOLDS)]
    mae = R.held_out_errors(train, specs)
    part = F.split("name", r"\|")
    rows = mae.select(F.upper(part[0]).alias("target"), part[1].alias("candidate"), "fold", "mae")
    order = Window.partitionBy("target").orderBy("mean", "candidate")  # eight candidates
    means = rows.groupBy("target", "candidate").agg(F.round(F.avg("mae"), 12).alias("mean")).withColumn("selected", F.row_number().over(order) == 1)
    return rounded(rows.join(means.drop("mean"), ["target", "candidate"]))


@query("l5_mean_baseline", with_views("scored", f"""WITH t AS (SELECT 'V' AS target, y_v AS truth, split FROM scored UNION ALL SELECT 'G', y_g, split FROM scored), m AS (SELECT target, avg(truth) AS p FROM t WHERE split='model_train' GROUP BY target)
SELECT t.target, {r('max(p)', 'prediction')}, {r('avg(abs(p-truth))', 'mae')} FROM t JOIN m ON t.target=m.target GROUP BY t.target"""))
def _l5(spark, sf):
    rows = scored(spark, sf).select("split", F.expr("stack(2, 'V', y_v, 'G', y_g) AS (target, truth)"))
    mean = rows.where("split = 'model_train'").groupBy("target").agg(F.avg("truth").alias("prediction"))
    j = rows.join(F.broadcast(mean), "target")  # two rows
    return rounded(j.groupBy("target").agg(F.max("prediction").alias("prediction"), F.avg(F.abs(c("prediction") - c("truth"))).alias("mae")))


@query("l6_length_disagreement")
def _l6(spark, sf):
    """Length-only models of both families, their queue, its exact tail and the random queues."""
    items = _items(spark, sf).withColumns({"log_words": F.log("word_count"), "root_words": F.sqrt("word_count")})
    length = ["word_count", "log_words", "root_words"]
    train = _train(items)
    sums = N.gram(train, length, list(TARGETS.values()))
    out = R.predict(items, R.grow(train, [_forest(t, y, length, depth=None) for t, y in TARGETS.items()]), {f"lf_{t}": t for t in TARGETS})
    for t, y in TARGETS.items():
        out = N.solve(sums, y, 1.0).transform(out, f"lr_{t}")
    large = F.greatest(*[F.abs((c(f"lr_{t}") + c(f"lf_{t}")) / 2 - c(y)) for t, y in TARGETS.items()]) >= 1
    d = F.greatest(*[F.abs(c(f"lr_{t}") - c(f"lf_{t}")) for t in TARGETS])
    q = materialise(queue(out.select("item_id", d.alias("d"), large.alias("large")), [F.desc("d"), "item_id"], 0.2), "queue")
    tail = X.hypergeometric_tail(X.fold_counts(q.withColumn("signal", F.lit("length_disagreement")), ["signal"]), "n", "positives", "k", "caught")
    random = X.intervals(X.random_captures(X.queue_counts(q, 0.2), 1000, 42), "captured")
    return rounded(with_row(tail, random.select(c("mean").alias("random_mean"), c("low").alias("random_low"), c("high").alias("random_high"))), 7)


@query("l7_predict_all", with_views("scored", f"{_FOUR} SELECT item_id, round(linear_v, 7) AS linear_v, round(forest_v, 7) AS forest_v, round(linear_g, 7) AS linear_g, round(forest_g, 7) AS forest_g FROM four"))
def _l7(spark, sf):
    return rounded(_four(_items(spark, sf))[0].select("item_id", "linear_v", "forest_v", "linear_g", "forest_g"), 7)


@query("l8_band_weights", with_views("scored", """WITH b AS (SELECT item_id, CASE WHEN y_v<=2.5 THEN 'low' WHEN y_v<=3.5 THEN 'middle' ELSE 'high' END AS band FROM scored), w AS (SELECT item_id, 1/sqrt(count(*) OVER (PARTITION BY band)) AS w FROM b)
SELECT item_id, round(w/avg(w) OVER (), 9) AS weight FROM w"""))
def _l8(spark, sf):
    return rounded(L.band_weights(scored(spark, sf), "y_v").select("item_id", "weight"))


@query("l9_ordinal")
def _l9(spark, sf):
    items = _items(spark, sf)
    return L.ordinal(FEATURES, "y_v")(_train(items)).transform(items).select("item_id", "prediction")


@query("l10_huber")
def _l10(spark, sf):
    items = _items(spark, sf)
    return L.huber(FEATURES, "y_v")(_train(items)).transform(items).select("item_id", "prediction")


_RIDGE_VARIANTS = {f"{t}{f}{w}": (y, f"cv_fold<>{f}") for t, y in TARGETS.items() for f in FOLDS for w in ("", "_weighted")}


def _long(df, target, truth, names):
    """Long rows of the named prediction columns."""
    packed = F.array(*[F.struct(F.lit(n).alias("variant"), c(p).alias("prediction")) for n, p in names.items()])
    return df.select("item_id", "cv_fold", F.lit(target).alias("target"), c(truth).alias("truth"), F.inline(packed))


def _ridge_rows(train, sums, variants, alpha=CHOSEN):
    """``variants``: name -> (features, weighted); out-of-fold rows of both targets from one pass."""
    parts = []
    for t, y in TARGETS.items():
        out = train
        for i, (features, weighted) in enumerate(variants.values()):
            out = N.out_of_fold(out, N.fold_lines(sums, y, alpha[t], FOLDS, features=features, weighted=weighted), f"_p{i}")
        parts.append(_long(out, t.upper(), y, {n: f"_p{i}" for i, n in enumerate(variants)}))
    return reduce(DataFrame.unionByName, parts)


def _forest_rows(train, variants):
    """As ``_ridge_rows`` for forests: all folds, targets and variants are grown together."""
    specs, parts = [], []
    for t, y in TARGETS.items():
        for n, (features, weighted) in variants.items():
            specs += R.folds_of(_forest(f"{t}|{n}", y, features, weighted=weighted), FOLDS)
    forests = R.grow(train, specs)
    for t, y in TARGETS.items():
        names = {f"_p{i}": f"{t}|{n}/*" for i, n in enumerate(variants)}
        parts.append(_long(R.predict(train, forests, names), t.upper(), y, {n: f"_p{i}" for i, n in enumerate(variants)}))
    return reduce(DataFrame.unionByName, parts)


_EXT = f"""{r(Z.mae('y', 'p'), 'mae')}, {r(Z.rmse('y', 'p'), 'rmse')}, {r(Z.r2('y', 'p'), 'r2')}, {r('avg(p-y)', 'mean_bias')}, {r(Z.within(0.5, 'y', 'p'), 'within_half')}, {r(Z.within(1.0, 'y', 'p'), 'within_one')},
{r(Z.slope('y', 'p'), 'calibration_slope')}, {r('stddev_samp(p)', 'prediction_sd')}, {r('stddev_samp(y)', 'human_sd')}"""


def _oof_sql(variants: dict, weighted: dict) -> str:
    """CTE ``o`` (target, variant, p, y) of ridge variants: one system per target, fold and variant."""
    ctes, rows = [], []
    for i, (name, features) in enumerate(variants.items()):
        fits = {f"{t}{f}": (y, f"cv_fold<>{f}") for t, y in TARGETS.items() for f in FOLDS}
        ctes.append(ridge_ctes("wide", fits, features, dict.fromkeys(fits, weighted[name]), tag=f"_{i}"))
        rows.append(f"SELECT item_id, cv_fold, upper(t) AS target, '{name}' AS variant, {line_sql(features)} AS p, CASE WHEN t = 'v' THEN y_v ELSE y_g END AS y FROM wide, (SELECT unnest(['v', 'g']) AS t) JOIN lin_{i} ON fit = t || cv_fold AND alpha = CASE WHEN t = 'v' THEN 100.0 ELSE 0.1 END")
    return f"al AS (SELECT unnest([0.1, 100.0])::DOUBLE AS alpha), {', '.join(ctes)}, o AS ({' UNION ALL '.join(rows)})"


_WIDE = "wide AS (SELECT *, ln(word_count) AS log_words, sqrt(word_count) AS root_words FROM scored WHERE cv_fold IS NOT NULL)"
_RIDGES = {"ridge_baseline": (FEATURES, False), "ridge_weighted": (FEATURES, True)}


@query("l11_linear_variants", with_views("scored", f"WITH RECURSIVE {_WIDE}, {_oof_sql({n: f for n, (f, _) in _RIDGES.items()}, {n: w for n, (_, w) in _RIDGES.items()})} SELECT target, variant, {_EXT} FROM o GROUP BY ALL"))
def _l11a(spark, sf):
    train = _train(_items(spark, sf))
    rows = _ridge_rows(train, N.gram(train, FEATURES, list(TARGETS.values()), "cv_fold"), _RIDGES)
    return rounded(E.extended_table(rows, ["target", "variant"]))


@query("l11_variants")
def _l11(spark, sf):
    """Six challengers, both targets, five folds; the absolute-error forests are not offered."""
    train = _train(_items(spark, sf))
    parts = [
        _ridge_rows(train, N.gram(train, FEATURES, list(TARGETS.values()), "cv_fold"), _RIDGES),
        _forest_rows(train, {"rf_baseline": (FEATURES, False), "rf_weighted": (FEATURES, True)}),
    ]
    for t, y in TARGETS.items():
        own = {"huber": (L.huber(FEATURES, y), False), "ordinal_logistic": (L.ordinal(FEATURES, y), False)}
        parts.append(L.variant_predictions(train, y, own, "item_id").withColumn("target", F.lit(t.upper())))
    return rounded(E.extended_table(reduce(DataFrame.unionByName, parts), ["target", "variant"]))


@query("l12_out_of_fold", with_views("scored", f"WITH RECURSIVE {_WIDE}, {_oof_sql({'ridge': FEATURES}, {'ridge': False})} SELECT item_id, cv_fold, target, round(p, 7) AS prediction FROM o"))
def _l12(spark, sf):
    train = _train(_items(spark, sf))
    sums = N.gram(train, FEATURES, list(TARGETS.values()), "cv_fold")
    return rounded(_ridge_rows(train, sums, {"ridge": (FEATURES, False)}).select("item_id", "cv_fold", "target", "prediction"), 7)


@query("l13_nested_calibration")
def _l13(spark, sf):
    """The baseline forest of one target: five outer folds, four inner ones each, linear and isotonic calibrators."""
    train = _train(_items(spark, sf))
    out = R.nested_calibration(train, _forest("v", "y_v"), "item_id")
    return rounded(out.select("item_id", "cv_fold", "prediction", "linear_calibrated", "isotonic_calibrated"), 7)


_EXTRA = {"length": ["log_words", "root_words"], "linear": ["lin_g"], "forest": ["for_g"], "raters": ["r1_g", "r2_g"]}
_EXTRA["all"] = [f for group in _EXTRA.values() for f in group]
_BASE = ["word_count", "lin_v"]
_ABLATION = {"baseline": (_BASE, False)} | {f"v2_{g}": ([*_BASE, *cols], False) for g, cols in _EXTRA.items()} | {"v2_all_weighted": ([*_BASE, *_EXTRA["all"]], True)}


def _wide(train):
    return materialise(train.withColumns({"log_words": F.log("word_count"), "root_words": F.sqrt("word_count")}), "wide")


def _named(family):
    return {f"{family}_{n}": v for n, v in _ABLATION.items()}


@query("l14_ridge_ablation", with_views("scored", f"WITH RECURSIVE {_WIDE}, {_oof_sql({n: f for n, (f, _) in _named('ridge').items()}, {n: w for n, (_, w) in _named('ridge').items()})} SELECT target, variant, {_EXT} FROM o GROUP BY ALL"))
def _l14a(spark, sf):
    train = _wide(_train(_items(spark, sf)))
    rows = _ridge_rows(train, N.gram(train, [*_BASE, *_EXTRA["all"]], list(TARGETS.values()), "cv_fold"), _named("ridge"))
    return rounded(E.extended_table(rows, ["target", "variant"]))


@query("l14_ablation")
def _l14(spark, sf):
    """Base and base plus each of five groups, two families, and the weighted fits with all groups; both targets."""
    train = _wide(_train(_items(spark, sf)))
    linear = _ridge_rows(train, N.gram(train, [*_BASE, *_EXTRA["all"]], list(TARGETS.values()), "cv_fold"), _named("ridge"))
    return rounded(E.extended_table(linear.unionByName(_forest_rows(train, _named("rf"))), ["target", "variant"]))


@query("l15_tfidf_ridge")
def _l15(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", c("quality").cast("double").alias("y"))
    docs = materialise(docs.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int")), "labelled")
    out = L.tfidf_out_of_fold(docs, "doc_id", "text", "y", "fold")
    return out.select("doc_id", "fold", "prediction")


_DIM = 64
_E = [f"e{i}" for i in range(_DIM)]
_EMB = "em AS (SELECT vec_id, vec_id % 5 AS fold, label::DOUBLE AS y, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(_DIM)) + " FROM embeddings)"


@query("l16_embedding_ridge", f"WITH RECURSIVE {_EMB}, al AS (SELECT 10.0::DOUBLE AS alpha), {ridge_ctes('em', {str(f): ('y', f'fold<>{f}') for f in FOLDS}, _E, scale=False)} SELECT vec_id, y, round({line_sql(_E)}, 7) AS prediction FROM em JOIN lin ON fit = CAST(fold AS VARCHAR)")
def _l16(spark, sf):
    """Out of fold: each fold's vectors by the ridge of the others."""
    e = table(spark, sf, "embeddings").select("vec_id", (c("vec_id") % 5).cast("int").alias("fold"), c("label").cast("double").alias("y"), *[c("embedding")[i].cast("double").alias(n) for i, n in enumerate(_E)])
    sums = N.gram(e, _E, ["y"], "fold")
    lines = {f: N.solve(sums, "y", 10.0, without=(f,), scale=False) for f in FOLDS}
    return rounded(N.out_of_fold(e, lines, fold="fold").select("vec_id", "y", "prediction"), 7)


@query("l16_unit_norms", "SELECT count(*) AS rows, count(*) FILTER (WHERE abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE)))-1)>1e-4) AS not_unit FROM embeddings")
def _l16b(spark, sf):
    return L.unit_norm_report(table(spark, sf, "embeddings"), "embedding")


@query("l17_tree_spread")
def _l17(spark, sf):
    """Out of fold: the larger of both targets' spreads over the trees ranks the items of each fold."""
    s = _spreads(spark, sf)
    return rounded(queue(s.select("item_id", "cv_fold", "spread"), [F.desc("spread"), "item_id"], 0.2, ["cv_fold"]).select("item_id", "cv_fold", "spread", "rank", "selected"), 9)


def _spreads(spark, sf):
    train = _train(_items(spark, sf))
    forests = R.grow(train, [s for t, y in TARGETS.items() for s in R.folds_of(_forest(t, y), FOLDS)])
    out = R.predict(train, forests, {f"p_{t}": f"{t}/*" for t in TARGETS}, {f"p_{t}": f"sd_{t}" for t in TARGETS})
    large = F.greatest(*[F.abs(c(f"p_{t}") - c(y)) for t, y in TARGETS.items()]) >= 1
    return materialise(out.withColumns({"spread": F.round(F.greatest("sd_v", "sd_g"), 9), "large": large}), "spreads")


def _fold_result(rows, score, name):
    """Fold queues of a score: expected and exact pooled tail, and the score's AUROC over all folds."""
    q = queue(rows.select("item_id", "cv_fold", c(score).alias("score"), "large"), [F.desc("score"), "item_id"], 0.2, ["cv_fold"]).withColumn("signal", F.lit(name))
    q = materialise(q, "queue")
    tail = X.pooled_tail(X.fold_counts(q, ["signal", "cv_fold"]), ["signal"])
    return rounded(tail.join(auroc(q, "score", "large", ["signal"]), "signal"), 7)


@query("l17_spread_queue")
def _l17b(spark, sf):
    return _fold_result(_spreads(spark, sf), "spread", "tree_spread")


_SPREAD_FITS = {t: (y, _TRAIN, "split='official_test'") for t, y in TARGETS.items()}


@query("l17_frozen_spread", with_views("scored", f"""WITH {_trees_sql(_SPREAD_FITS)}, {predictions(True)}, sp AS (SELECT key, round(max(sd), 9) AS spread FROM pr GROUP BY key),
k AS (SELECT item_id, spread, row_number() OVER (ORDER BY spread DESC, item_id) AS rank, count(*) OVER () AS n FROM sp JOIN scored ON item_no = key) SELECT item_id, spread, rank, rank <= ceil(n*0.2::DOUBLE) AS selected FROM k"""))
def _l17c(spark, sf):
    """Forests of all training rows rank the items of the official test once."""
    items = _items(spark, sf)
    forests = R.grow(_train(items), [_forest(t, y) for t, y in TARGETS.items()])
    out = R.predict(items.where("split = 'official_test'"), forests, {f"p_{t}": t for t in TARGETS}, {f"p_{t}": f"sd_{t}" for t in TARGETS})
    spread = out.select("item_id", F.round(F.greatest("sd_v", "sd_g"), 9).alias("spread"))
    return queue(spread, [F.desc("spread"), "item_id"], 0.2).select("item_id", "spread", "rank", "selected")


@query("l18_error_model")
def _l18(spark, sf):
    """A forest on features and base predictions learns the larger error; its out-of-fold prediction ranks each fold."""
    err = F.greatest(F.abs(c("for_v") - c("y_v")), F.abs(c("for_g") - c("y_g")))
    rows = materialise(_train(_items(spark, sf)).withColumns({"error": err, "large": err >= 1}), "errors")
    features = [*FEATURES, "for_v"]
    out = R.predict(rows, R.grow(rows, R.folds_of(_forest("error", "error", features), FOLDS)), {"predicted": "error/*"})
    return _fold_result(out.withColumn("predicted", F.round("predicted", 9)), "predicted", "error_model")


@query("l19_model_weights", with_views("scored", f"""{_FOUR}, im AS (SELECT fit, f, sum(g/w) AS s FROM (SELECT fit, tree, f, sum(gain) AS g, sum(sum(gain)) OVER (PARTITION BY fit, tree) AS w FROM gn GROUP BY fit, tree, f) GROUP BY fit, f),
fe AS (SELECT unnest({FEATURES}) AS feature, unnest([{', '.join(str(i) for i in range(len(FEATURES)))}]) AS f)
SELECT 'linear_' || fit AS model, feature, round(b[f+1], 7) AS weight FROM lin_r, fe WHERE alpha = CASE WHEN fit = 'v' THEN 100.0 ELSE 0.1 END
UNION ALL SELECT 'forest_' || t, feature, round(coalesce(s/sum(s) OVER (PARTITION BY t), 0), 7) FROM fe CROSS JOIN (SELECT unnest(['v', 'g']) AS t) LEFT JOIN im ON im.fit = t AND im.f = fe.f"""))
def _l19(spark, sf):
    """Standardised coefficients of the linear models, impurity importances of the forests."""
    _, lines, forests = _four(_items(spark, sf))
    linear = spark.createDataFrame([(f"linear_{t}", f, float(b)) for t, line in lines.items() for f, b in zip(line.features, line.scaled)], "model string, feature string, weight double")
    trees = R.importances(forests).select(F.concat(F.lit("forest_"), c("forest")).alias("model"), "feature", c("importance").alias("weight"))
    return rounded(linear.unionByName(trees), 7)


@query("l20_reference_medians", with_views("scored", "SELECT cv_fold, quantile_cont(lin_v, 0.5) AS centre_v, quantile_cont(lin_g, 0.5) AS centre_g FROM scored WHERE cv_fold IS NOT NULL GROUP BY cv_fold"))
def _l20(spark, sf):
    from marklens.operators.order import quantiles

    s = scored(spark, sf).where(c("cv_fold").isNotNull())
    return quantiles(s, "lin_v", {"centre_v": 0.5}, ["cv_fold"]).join(quantiles(s, "lin_g", {"centre_g": 0.5}, ["cv_fold"]), "cv_fold")


@query("a12_saved_models", with_views("scored", "SELECT unnest(['forest', 'huber', 'line', 'ordinal', 'pipeline', 'tfidf', 'weighted']) AS kind, unnest([n, n, n, n, n, d, n]) AS rows, 0::BIGINT AS differ FROM (SELECT count(*) AS n FROM scored), (SELECT count(*) AS d FROM documents JOIN labels USING (doc_id))"))
def _a12(spark, sf):
    """Every kind of model saved, loaded and compared by its predictions."""
    items = _items(spark, sf)
    train = _train(items)
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", c("quality").cast("double").alias("y"))
    docs = materialise(docs, "labelled")
    path = f"{scratch_dir(spark)}/marklens-models-{uuid.uuid4().hex}"
    sums = N.gram(train, FEATURES, ["y_v"])
    models = {
        "pipeline": L.ridge(FEATURES, "y_v", 1.0)(train), "weighted": L.weighted_fit(L.ridge(FEATURES, "y_v", 1.0, weight="weight"), "y_v")(train), "huber": L.huber(FEATURES, "y_v")(train),
        "ordinal": L.ordinal(FEATURES, "y_v")(train), "tfidf": L.tfidf_ridge("doc_id", "text", "y")(docs), "line": N.solve(sums, "y_v", 1.0), "forest": R.grow(train, [_forest("v", "y_v")]),
    }
    L.save_models(models, FEATURES, spark, path)
    again = L.load_models(spark, path, FEATURES)
    parts = []
    for kind, model in models.items():
        data, key = (docs, "doc_id") if kind == "tfidf" else (items, "item_no")
        run = (lambda m, d: R.predict(d, m, {"prediction": "v"})) if kind == "forest" else (lambda m, d: m.transform(d))
        a = run(model, data).select(key, c("prediction").alias("p"))
        b = run(again[kind], data).select(key, c("prediction").alias("q"))
        parts.append(a.join(b, key).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"), F.count_if(~(F.abs(c("p") - c("q")) <= 1e-10)).alias("differ")))
    return reduce(DataFrame.unionByName, parts)

