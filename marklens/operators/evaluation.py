"""Metric tables over predictions: overall, per band, per group, per fold, and decisions on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklens.functions import metrics as M
from marklens.functions import scalars as S
from marklens.operators.order import _join_on, quantiles
from marklens.schema import SCORE_MAX, SCORE_MIN
from marklens.session import materialise

# Two-sided 95% quantiles of Student's t for 1..30 degrees of freedom.
T_975 = (
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252,
    2.306004135, 2.262157163, 2.228138852, 2.200985160, 2.178812830, 2.160368656, 2.144786688,
    2.131449546, 2.119905299, 2.109815578, 2.100922040, 2.093024054, 2.085963447, 2.079613845,
    2.073873068, 2.068657610, 2.063898562, 2.059538553, 2.055529439, 2.051830516, 2.048407142,
    2.045229642, 2.042272456,
)

_Y, _P = F.col, F.col


def _yp() -> tuple[Column, Column]:
    return F.col("truth"), F.col("prediction")


def metric_table(long: DataFrame, by: Sequence[str] = ("target", "model")) -> DataFrame:
    y, p = _yp()
    return long.groupBy(*by).agg(*M.named(M.regression_columns(y, p)))


def extended_table(long: DataFrame, by: Sequence[str]) -> DataFrame:
    y, p = _yp()
    return long.groupBy(*by).agg(*M.named(M.extended_columns(y, p)))


def distribution_table(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, sample sd and the five-number summary per group."""
    basic = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"),
    )
    q = quantiles(df, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, list(by))
    return _join_on(basic, q, list(by))


def by_truth_table(long: DataFrame) -> DataFrame:
    """Predictions at each observed truth level; the sd of a single row is NULL."""
    y, p = _yp()
    return long.groupBy("target", "model", "truth").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_prediction"), F.stddev_samp(p).alias("sd_prediction"),
        M.bias(y, p).alias("bias"), M.mae(y, p).alias("mae"),
        M.within(y, p, 0.5).alias("within_half"), M.within(y, p, 1.0).alias("within_one"),
    )


def point_predictors(metrics: DataFrame, first: str, second: str, tie: float = 1e-12) -> DataFrame:
    """Per target the family with the lower MAE; the first family wins ties."""
    val = lambda m: F.max(F.when(F.col("model") == m, F.col("mae")))
    out = metrics.groupBy("target").agg(val(first).alias("mae_first"), val(second).alias("mae_second"))
    pick = F.when(F.col("mae_second") < F.col("mae_first") - tie, second).otherwise(first)
    return out.select("target", pick.alias("selected_model"), F.least("mae_first", "mae_second").alias("selected_mae"))


def baseline_comparison(metrics: DataFrame, baselines: DataFrame) -> DataFrame:
    """Every model against every baseline of the same target."""
    b = baselines.select("target", F.col("baseline"), F.col("mae").alias("baseline_mae"))
    out = metrics.join(b, "target")
    gain = F.col("baseline_mae") - F.col("mae")
    return out.select(
        "target", "model", "baseline", gain.alias("mae_reduction"),
        (100 * F.try_divide(gain, F.col("baseline_mae"))).alias("improvement_percent"),
    )


def missing_baselines(metrics: DataFrame, baselines: DataFrame) -> DataFrame:
    return metrics.join(baselines.select("target").distinct(), "target", "left_anti")


def error_table(long: DataFrame) -> DataFrame:
    y, p = _yp()
    return long.withColumn("residual", p - y).withColumn("absolute_error", F.abs(p - y))


def error_summary(long: DataFrame, by: Sequence[str] = ("target", "model")) -> DataFrame:
    e = error_table(long)
    p = F.col("prediction")
    basic = e.groupBy(*by).agg(
        F.avg("absolute_error").alias("mean_error"), F.max("absolute_error").alias("max_error"),
        F.count_if(p < SCORE_MIN).alias("below_scale"), F.count_if(p > SCORE_MAX).alias("above_scale"),
    )
    q = quantiles(e, "absolute_error", {"median_error": 0.5, "p90_error": 0.9}, list(by))
    return _join_on(basic, q, list(by))


def grouped_metrics(long: DataFrame, groupings: dict[str, Column], minimum: int) -> DataFrame:
    """MAE, RMSE and bias per value of several groupings in one aggregate; small groups are left out."""
    y, p = _yp()
    packed = F.array(*[F.struct(F.lit(k).alias("group_type"), v.alias("group_value")) for k, v in groupings.items()])
    rows = long.select("target", "model", "truth", "prediction", F.inline(packed))
    out = rows.groupBy("target", "model", "group_type", "group_value").agg(
        F.count(F.lit(1)).alias("n"), M.mae(y, p).alias("mae"), M.rmse(y, p).alias("rmse"), M.bias(y, p).alias("bias")
    )
    return out.where(F.col("n") >= minimum)


def band_table(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics in the low, middle and high truth bands; empty bands appear with n = 0."""
    y, p = _yp()
    bands = ("low", "middle", "high")
    out = long.withColumn("band", S.score_band(y)).groupBy(*by, "band").agg(
        F.count(F.lit(1)).alias("n"), M.mae(y, p).alias("mae"), M.bias(y, p).alias("signed_bias"),
        M.within(y, p, 0.5).alias("within_half"), M.within(y, p, 1.0).alias("within_one"),
    )
    grid = out.select(*by).distinct().withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands])))
    return grid.join(out, [*by, "band"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def fold_interval(folds: DataFrame, by: Sequence[str], value: str = "mae") -> DataFrame:
    """Mean over folds with a two-sided 95% t interval; NULL ends for a single fold.

    Beyond the table the quantile is the normal one's expansion in 1/df, right to seven digits from 31 on.
    """
    df, z = F.col("folds") - 1, F.lit(1.959963984540054)
    far = (
        z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)
        + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * df**4)
    )
    t = F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in T_975]), df.cast("int")), far)
    out = folds.groupBy(*by).agg(
        F.count(value).alias("folds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd")
    )
    half = F.when(F.col("folds") > 1, t * F.col("_sd") / F.sqrt(F.col("folds")))
    return out.select(*by, "folds", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def error_cells(long: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Errors overall, per truth band and per fold of each target and variant, from one reading of the items.

    The cells (target, variant, band, fold) are one small written table; all three tables are sums of it.
    """
    y, p = _yp()
    cells = long.groupBy("target", "variant", S.score_band(y).alias("band"), "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(p - y)).alias("a"), F.sum(p - y).alias("s")
    )
    cells = materialise(cells, "cells")

    def per(*by: str) -> DataFrame:
        mae, bias = F.sum("a") / F.sum("n"), F.sum("s") / F.sum("n")
        return cells.groupBy("target", "variant", *by).agg(mae.alias("mae"), bias.alias("signed_bias"))

    return per(), per("band"), per("fold")


def acceptance(
    overall: DataFrame, bands: DataFrame, folds: DataFrame, baseline: str, max_overall_increase: float = 0.005,
    min_macro_gain: float = 0.10, min_tail_cut: float = 0.20, max_group_increase: float = 0.05, min_folds: int = 4,
) -> DataFrame:
    """Five acceptance rules per target and variant, each against the baseline variant's rows."""
    is_base = F.col("variant") == baseline

    def against(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
        base = df.where(is_base).select(*keys, *[F.col(c).alias(f"base_{c}") for c in cols])
        return df.where(~is_base).join(base, keys)

    o = against(overall, ["target"], ["mae"]).select(
        "target", "variant", (F.col("mae") - F.col("base_mae")).alias("overall_change")
    )
    tail = F.col("band").isin("low", "high")
    b = against(bands, ["target", "band"], ["mae", "signed_bias"]).groupBy("target", "variant").agg(
        F.avg("mae").alias("macro"), F.avg("base_mae").alias("base_macro"),
        F.max(F.when(tail, F.abs("signed_bias"))).alias("tail"), F.max(F.when(tail, F.abs("base_signed_bias"))).alias("base_tail"),
        F.max(F.col("mae") - F.col("base_mae")).alias("worst_band_increase"),
    )
    b = b.select(
        "target", "variant", ((F.col("base_macro") - F.col("macro")) / F.col("base_macro")).alias("macro_gain"),
        F.coalesce(F.try_divide(F.col("base_tail") - F.col("tail"), F.col("base_tail")), F.lit(0.0)).alias("tail_cut"),
        "worst_band_increase",
    )
    f = against(folds, ["target", "fold"], ["mae"]).groupBy("target", "variant").agg(
        F.count_if(F.col("mae") < F.col("base_mae")).alias("improved_folds")
    )
    out = o.join(b, ["target", "variant"]).join(f, ["target", "variant"])
    rules = {
        "overall_pass": F.col("overall_change") <= max_overall_increase,
        "macro_pass": F.col("macro_gain") >= min_macro_gain,
        "tail_pass": F.col("tail_cut") >= min_tail_cut,
        "group_pass": F.col("worst_band_increase") <= max_group_increase,
        "folds_pass": F.col("improved_folds") >= min_folds,
    }
    out = out.withColumns(rules)
    every = F.lit(True)
    for r in rules:
        every = every & F.col(r)
    return out.withColumn("accepted", every)


def fold_mean_baseline(long: DataFrame, fold: str = "cv_fold") -> DataFrame:
    """Predict each fold by the mean truth of the other folds; sums per fold, no second scan for means."""
    per = long.groupBy("target", fold).agg(F.count(F.lit(1)).alias("_n"), F.sum("truth").alias("_s"))
    w = Window.partitionBy("target")
    means = per.select(
        "target", fold, ((F.sum("_s").over(w) - F.col("_s")) / (F.sum("_n").over(w) - F.col("_n"))).alias("prediction")
    )
    return long.drop("prediction").join(F.broadcast(means), ["target", fold])  # targets x folds


def mean_baseline(long: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """MAE of the constant mean prediction per group, at distinct-truth grain."""
    levels = long.groupBy(*by, "truth").agg(F.count(F.lit(1)).alias("_n"))
    total = levels.groupBy(*by).agg((F.sum(F.col("truth") * F.col("_n")) / F.sum("_n")).alias("_m"))
    j = _join_on(levels, total, list(by))
    return j.groupBy(*by).agg((F.sum(F.abs(F.col("truth") - F.col("_m")) * F.col("_n")) / F.sum("_n")).alias("mae"))


def spread_table(long: DataFrame, by: Sequence[str] = ("target", "model")) -> DataFrame:
    """Population sd of truth and prediction, their ratio, ranges, 5/95% points, correlation and slope."""
    y, p = _yp()
    basic = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(y).alias("sd_true"), F.stddev_pop(p).alias("sd_pred"),
        (F.stddev_pop(p) / F.stddev_pop(y)).alias("ratio"),
        F.min(y).alias("true_min"), F.max(y).alias("true_max"), F.min(p).alias("pred_min"), F.max(p).alias("pred_max"),
        M.pearson(y, p).alias("pearson"), M.slope(y, p).alias("slope"),
    )
    qy = quantiles(long, "truth", {"true_p05": 0.05, "true_p95": 0.95}, list(by))
    qp = quantiles(long, "prediction", {"pred_p05": 0.05, "pred_p95": 0.95}, list(by))
    return _join_on(_join_on(basic, qy, list(by)), qp, list(by))


def confusion(df: DataFrame, truth: str, seen: str, levels: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Full square of counts; absent cells are 0."""
    counts = df.groupBy(*by, truth, seen).agg(F.count(F.lit(1)).alias("n"))
    lv = F.array(*[F.lit(x) for x in levels])
    grid = df.select(*by).distinct().withColumn(truth, F.explode(lv)).withColumn(seen, F.explode(lv))
    return grid.join(counts, [*by, truth, seen], "left").withColumn("n", F.coalesce("n", F.lit(0)))
