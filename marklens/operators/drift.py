"""Drift of features between two populations, correlations, least-squares lines."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklens.functions.metrics import pearson
from marklens.operators.order import average_ranks, quantiles_of_counts, running_sums, value_join
from marklens.operators.profile import unpivot
from marklens.session import materialise

# Fixed thresholds of the feature audit.
NEAR_CONSTANT_SD, NEAR_CONSTANT_SHARE = 1e-8, 0.95
SMD_LIMIT, PSI_LIMIT, KS_LIMIT, PSI_BINS, SIMILARITY = 0.20, 0.10, 0.10, 10, 0.95
SHARE_FLOOR = 1e-6


def feature_rows(df: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    return unpivot(df, features, [split])


def value_counts(rows: DataFrame, fit: Column, other: Column, segments: int | None = None) -> DataFrame:
    """Counts ``a`` (fit) and ``b`` (other) per distinct feature value with running sums.

    One scan of the items feeds every drift statistic: the written table at the grain
    (feature, value) replaces the rows.  Missing values keep their own row and no place in the order.
    """
    v = F.when(~F.isnan("value"), F.col("value"))
    counts = rows.where(fit | other).groupBy("feature", v.alias("value")).agg(
        F.count_if(fit).alias("n_a"), F.count_if(other).alias("n_b")
    )
    present = F.col("value").isNotNull()
    counts = counts.withColumns(
        {"a": F.when(present, F.col("n_a")).otherwise(0), "b": F.when(present, F.col("n_b")).otherwise(0)}
    )
    return running_sums(counts, "value", ["a", "b"], ["feature"], segments)


def _weighted(base: DataFrame) -> DataFrame:
    """Mean and sample sd of both populations from value counts (centred in a second step)."""
    v = F.col("value")
    means = base.groupBy("feature").agg(
        (F.sum(v * F.col("a")) / F.sum("a")).alias("train_mean"), (F.sum(v * F.col("b")) / F.sum("b")).alias("other_mean")
    )
    j = base.join(F.broadcast(means), "feature")  # one row per feature
    ss = lambda w, m: F.sqrt(F.sum(F.col(w) * (v - F.col(m)) * (v - F.col(m))) / (F.sum(w) - 1))
    return j.groupBy("feature", "train_mean", "other_mean").agg(
        ss("a", "train_mean").alias("train_std"), ss("b", "other_mean").alias("other_std")
    )


def feature_quality(base: DataFrame) -> DataFrame:
    """Quality of each feature in the fit population; outliers of both under the fit fences."""
    v, a, b = F.col("value"), F.col("a"), F.col("b")
    missing, infinite, seen = v.isNull(), F.abs(v) == float("inf"), F.col("a") > 0
    total = lambda cond, n: F.sum(F.when(cond, F.col(n)).otherwise(0))
    basic = base.groupBy("feature").agg(
        total(missing, "n_a").alias("train_missing"), total(missing, "n_b").alias("other_missing"),
        total(infinite, "n_a").alias("train_infinite"), total(infinite, "n_b").alias("other_infinite"),
        F.sum("n_a").alias("train_n"), F.sum("n_b").alias("other_n"),
        F.min(F.when(seen, v)).alias("train_min"), F.max(F.when(seen, v)).alias("train_max"),
        F.count_if(seen).alias("train_unique"), (F.max("a") / F.sum("a")).alias("dominant_share"),
    )
    spread = _weighted(base).select("feature", "train_mean", "train_std")
    q = quantiles_of_counts(base.where(seen), "value", "a", {"p01": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}, ["feature"])
    fences = q.withColumns(
        {
            "lower_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
            "upper_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
        }
    )
    out_of = ~v.between(F.col("lower_fence"), F.col("upper_fence"))
    outliers = base.join(F.broadcast(fences), "feature").groupBy("feature").agg(  # one row per feature
        total(out_of, "a").alias("train_outliers"), total(out_of, "b").alias("other_outliers")
    )
    out = basic.join(spread, "feature").join(fences, "feature").join(outliers, "feature")
    return out.withColumns(
        {
            "train_outlier_share": F.try_divide(F.col("train_outliers"), F.col("train_n")),
            "other_outlier_share": F.try_divide(F.col("other_outliers"), F.col("other_n")),
            "near_constant": (F.col("train_std") <= NEAR_CONSTANT_SD) | (F.col("dominant_share") >= NEAR_CONSTANT_SHARE),
        }
    )


def mean_differences(base: DataFrame) -> DataFrame:
    """Means, sds and the standardised mean difference (root mean of both variances)."""
    pooled = F.sqrt((F.col("train_std") * F.col("train_std") + F.col("other_std") * F.col("other_std")) / 2)
    smd = F.when(pooled > 0, (F.col("other_mean") - F.col("train_mean")) / pooled).otherwise(F.lit(0.0))
    return _weighted(base).withColumn("smd", smd)


def stability_index(base: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """Population stability index on distinct fit quantiles; empty bins count with a small share."""
    probs = {f"e{i}": i / bins for i in range(1, bins)}
    edges = quantiles_of_counts(base.where("a > 0"), "value", "a", probs, ["feature"]).select(
        "feature", F.array_distinct(F.array(*probs)).alias("edges")
    )
    v = F.col("value")
    placed = base.where(v.isNotNull()).join(F.broadcast(edges), "feature")  # one row per feature
    placed = placed.withColumn("bin", F.size(F.filter("edges", lambda e: v >= e)))
    counts = placed.groupBy("feature", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    full = grid.join(counts, ["feature", "bin"], "left").na.fill(0, ["a", "b"])
    w = Window.partitionBy("feature")  # at most ``bins`` rows per feature
    p = F.greatest(F.col("a") / F.sum("a").over(w), F.lit(SHARE_FLOOR))
    q = F.greatest(F.col("b") / F.sum("b").over(w), F.lit(SHARE_FLOOR))
    return full.withColumn("_t", (q - p) * F.ln(q / p)).groupBy("feature").agg(F.sum("_t").alias("psi"))


def ks_distance(base: DataFrame) -> DataFrame:
    gap = F.abs(F.col("cum_a") / F.col("total_a") - F.col("cum_b") / F.col("total_b"))
    return base.groupBy("feature").agg(F.max(gap).alias("ks"))


def stability_verdict(base: DataFrame) -> DataFrame:
    """SMD, KS and PSI per feature and whether all three stay under their thresholds."""
    out = mean_differences(base).join(ks_distance(base), "feature").join(stability_index(base), "feature")
    ok = (F.abs("smd") <= SMD_LIMIT) & (F.col("psi") <= PSI_LIMIT) & (F.col("ks") <= KS_LIMIT)
    return out.withColumn("stable", ok)


def rank_features(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Average rank of every feature, one wide row per item."""
    rows = materialise(unpivot(df, features, [key]), "long")
    ranks = materialise(average_ranks(rows, "value", ["feature"]).select("feature", "value", "avg_rank", "rows"), "ranks")
    ranked = value_join(rows, ranks, ["feature", "value"], "rows")
    at = [F.max(F.when(F.col("feature") == f, F.col("avg_rank"))).alias(f) for f in features]
    return ranked.groupBy(key).agg(*at)


def _pair_rows(df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    """Pearson of every feature pair in one pass."""
    cells = F.array(
        *[F.struct(F.lit(a).alias("feature_left"), F.lit(b).alias("feature_right"),
                   pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(name))
          for a, b in combinations(features, 2)]
    )
    return df.agg(cells.alias("x")).select(F.inline("x"))


def correlation_pairs(df: DataFrame, key: str, features: Sequence[str], threshold: float = SIMILARITY) -> DataFrame:
    """Pearson and Spearman of all feature pairs, similar pairs first, then by absolute Pearson."""
    straight = _pair_rows(df, features, "pearson")
    n = df.select(F.count(F.lit(1)).alias("n")).select("n").scalar()
    centred = rank_features(df, key, features).select(*[(F.col(f) - (n + 1) / 2).alias(f) for f in features])
    ranked = _pair_rows(centred, features, "spearman")
    out = straight.join(ranked, ["feature_left", "feature_right"])
    out = out.withColumn("high_similarity", (F.abs("pearson") >= threshold) | (F.abs("spearman") >= threshold))
    return out.orderBy(F.desc("high_similarity"), F.desc(F.abs("pearson")))


def band_line(df: DataFrame, y: Column, x: Column, band: Column) -> DataFrame:
    """Three least-squares fits from per-band moments: y~x, y~band and y~band+x with R squared."""
    m = df.select(y.alias("y"), x.alias("x"), band.alias("band")).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"),
        F.sum(F.col("x") * F.col("y")).alias("sxy"),
    )
    s = {k: F.sum(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")}
    cxx, cyy, cxy = s["sxx"] - s["sx"] * s["sx"] / s["n"], s["syy"] - s["sy"] * s["sy"] / s["n"], s["sxy"] - s["sx"] * s["sy"] / s["n"]
    wxx = F.sum(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
    wyy = F.sum(F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    wxy = F.sum(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"))
    fit = lambda name, b, sse: F.struct(F.lit(name).alias("model"), b.alias("slope"), (F.lit(1.0) - sse / cyy).alias("r2"))
    rows = F.array(
        fit("x_only", F.try_divide(cxy, cxx), cyy - F.try_divide(cxy * cxy, cxx)),
        fit("band_only", F.lit(None).cast("double"), wyy),
        fit("band_plus_x", F.try_divide(wxy, wxx), wyy - F.try_divide(wxy * wxy, wxx)),
    )
    return m.agg(s["n"].alias("n"), rows.alias("r")).select("n", F.inline("r"))


def z_profile(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Population z-scores and each item's features ordered by absolute z."""
    from marklens.operators.order import with_row

    stats = df.agg(*[f for x in features for f in (F.avg(x).alias(f"_m_{x}"), F.stddev_pop(x).alias(f"_s_{x}"))])
    wide = with_row(df.select(key, *features), stats)
    z = [F.struct(F.lit(x).alias("feature"), F.try_divide(F.col(x) - F.col(f"_m_{x}"), F.col(f"_s_{x}")).alias("z")) for x in features]
    order = lambda a, b: (
        F.when(F.abs(a["z"]) > F.abs(b["z"]), -1).when(F.abs(a["z"]) < F.abs(b["z"]), 1)
        .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)
    )
    return wide.select(key, F.posexplode(F.array_sort(F.array(*z), order)).alias("pos", "s")).select(
        key, (F.col("pos") + 1).alias("z_rank"), "s.feature", "s.z"
    )
