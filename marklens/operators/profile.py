"""Column profiles, distributions and contrasts for descriptive tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marklens.operators.order import _join_on, quantiles, with_row


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _key(field: T.StructField) -> Column:
    """Texts are counted by their hash, so that only hashes are shuffled."""
    return F.sha2(field.name, 256) if isinstance(field.dataType, T.StringType) else F.col(field.name)


def column_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Type, non-null, missing and distinct count per column: one aggregate per table."""
    parts = []
    for source, df in tables.items():
        rows = F.array(
            *[
                F.struct(F.lit(source).alias("source"), F.lit(f.name).alias("column_name"),
                         F.lit(f.dataType.simpleString()).alias("dtype"), F.count(f.name).alias("non_null"),
                         (F.count(F.lit(1)) - F.count(f.name)).alias("missing"),
                         F.count_distinct(_key(f)).alias("distinct_values"))
                for f in df.schema.fields
            ]
        )
        parts.append(df.agg(rows.alias("x")).select(F.inline("x")))
    return _union(parts)


def file_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and rows without any NULL per source; bytes and digests of files: ``sources.tables.file_bytes``."""
    parts = []
    for source, df in tables.items():
        complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns])
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(complete).alias("complete_rows")).select(
                F.lit(source).alias("source"), "rows", F.lit(len(df.columns)).alias("columns"), "complete_rows"
            )
        )
    return _union(parts)


def score_shares(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    counts = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def length_summary(df: DataFrame, length: str, text: str, by: list[str]) -> DataFrame:
    """Five-number summary of a length, distinct texts and short-text counts per group."""
    basic = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean_words"),
        F.stddev_samp(length).alias("sd_words"), F.min(length).alias("min_words"), F.max(length).alias("max_words"),
        F.count_if(F.col(length) < 50).alias("under_50"), F.count_if(F.col(length) < 100).alias("under_100"),
    )
    # distinct texts by hash: the texts themselves never cross the network
    texts = df.select(*by, F.sha2(text, 256).alias("_h")).groupBy(*by).agg(F.count_distinct("_h").alias("distinct_texts"))
    q = quantiles(df, length, {"q25": 0.25, "median": 0.5, "q75": 0.75}, by)
    return _join_on(_join_on(basic, texts, by), q, by)


def matching_columns(df: DataFrame, pattern: str) -> DataFrame:
    """Summary of every column whose name matches a pattern, in one aggregate."""
    cols = [c for c in df.columns if re.search(pattern, c)]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("minimum"),
                     F.max(c).alias("maximum"), F.count_if(F.col(c) == 0).alias("zeros"))
            for c in cols
        ]
    )
    return df.agg(rows.alias("x")).select(F.inline("x"))


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence[str]) -> DataFrame:
    """Counts with a fixed set and order of columns; absent cells are 0."""
    return df.groupBy(row).pivot(column, list(levels)).count().na.fill(0)


def wide_summary(df: DataFrame, features: Sequence[str], by: list[str]) -> DataFrame:
    aggs = []
    for x in features:
        aggs += [
            F.count(x).alias(f"{x}_count"), F.avg(x).alias(f"{x}_mean"), F.stddev_samp(x).alias(f"{x}_std"),
            F.min(x).alias(f"{x}_min"), F.max(x).alias(f"{x}_max"),
        ]
    return df.groupBy(*by).agg(*aggs)


def group_spread(df: DataFrame, value: str, group: str) -> DataFrame:
    """Mean, median and IQR per group, and eta squared (between over total sum of squares)."""
    per = df.groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_ss")
    )
    q = quantiles(df, value, {"median": 0.5, "_q25": 0.25, "_q75": 0.75}, [group])
    grand = F.sum("_s") * F.sum("_s") / F.sum("n")
    eta = per.agg(((F.sum(F.col("_s") * F.col("_s") / F.col("n")) - grand) / (F.sum("_ss") - grand)).alias("eta_squared"))
    out = _join_on(per, q, [group]).select(group, "n", "mean", "median", (F.col("_q75") - F.col("_q25")).alias("iqr"))
    return with_row(out, eta)


def unpivot(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    packed = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.inline(packed))


def feature_contrast(df: DataFrame, features: Sequence[str], flag: str) -> DataFrame:
    """Means, medians and the standardised mean difference of flagged against other rows."""
    rows = unpivot(df, features, [flag])
    on = F.col(flag)
    m = rows.groupBy("feature").agg(
        F.avg(F.when(on, F.col("value"))).alias("mean_large"), F.avg(F.when(~on, F.col("value"))).alias("mean_other"),
        F.var_samp(F.when(on, F.col("value"))).alias("_vl"), F.var_samp(F.when(~on, F.col("value"))).alias("_vo"),
    )
    q = quantiles(rows, "value", {"median": 0.5}, ["feature", flag])
    q = q.groupBy("feature").agg(
        F.max(F.when(on, F.col("median"))).alias("median_large"), F.max(F.when(~on, F.col("median"))).alias("median_other")
    )
    pooled = F.sqrt((F.col("_vl") + F.col("_vo")) / 2)
    return m.join(q, "feature").select(
        "feature", "mean_large", "mean_other", "median_large", "median_other",
        F.try_divide(F.col("mean_large") - F.col("mean_other"), pooled).alias("smd"),
    )


def compare_splits(metrics: DataFrame, names: Sequence[str], by: list[str], first: str, second: str) -> DataFrame:
    """Long table: one metric per row, one column per split, and the change."""
    packed = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names]))
    rows = metrics.select(*by, "split", packed)
    at = lambda s: F.max(F.when(F.col("split") == s, F.col("v"))).alias(s)
    out = rows.groupBy(*by, "metric").agg(at(first), at(second))
    return out.withColumn("change", F.col(second) - F.col(first))


def score_grid(df: DataFrame, score: str, targets: Sequence[str], keep: Column) -> DataFrame:
    """Counts on the complete half-point grid; unseen levels are 0."""
    spark = df.sparkSession
    grid = spark.range(9).select((F.lit(1.0) + F.col("id") * 0.5).alias(score))
    grid = grid.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    counts = df.where(keep).groupBy("target", score).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["target", score], "left").withColumn("n", F.coalesce("n", F.lit(0)))
