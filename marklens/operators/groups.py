"""Group keys derived from other populations and summaries per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklens.operators.order import quantiles, with_row


def quantile_bands(
    df: DataFrame, reference: DataFrame, value: str, name: str, parts: int = 4
) -> DataFrame:
    """Q1.. bands of ``df`` cut at the distinct quantiles of a reference population; open ends."""
    probs = {f"q{i}": i / parts for i in range(1, parts)}
    edges = quantiles(reference, value, probs).select(F.array_distinct(F.array(*probs)).alias("_edges"))
    x = F.col(value)
    band = F.size(F.filter("_edges", lambda e: x >= e)) + 1
    out = with_row(df, edges)
    return out.withColumn(name, F.concat(F.lit("Q"), band.cast("string"))).drop("_edges")


def group_summary(df: DataFrame, keys: list[str], distributions: bool = False) -> DataFrame:
    """Error summary for arbitrary group keys; a NULL key stays a group of its own."""
    from pyspark.sql import Window

    sides = {}
    for t in ("v", "g"):
        e = F.col(f"for_{t}") - F.col(f"y_{t}")
        sides[f"{t}_mean_signed_error"] = F.avg(e)
        sides[f"{t}_over_rate"] = F.avg((e > 0).cast("double"))
        sides[f"{t}_under_rate"] = F.avg((e < 0).cast("double"))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("d_max").alias("mean_disagreement"), F.avg("max_err").alias("mean_max_error"),
        F.avg("word_count").alias("mean_words"), F.count_if("large").alias("large_count"),
        F.avg(F.col("large").cast("double")).alias("prevalence"), *[v.alias(k) for k, v in sides.items()],
    )
    total = df.select(F.count(F.lit(1)).alias("_all"))
    out = with_row(out, total).withColumn("percentage", 100.0 * F.col("n") / F.col("_all")).drop("_all")
    if distributions:
        for t in ("v", "g"):
            out = _null_safe(out, score_distribution(df, f"y_{t}", keys, f"{t}_scores"), keys)
    return out


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    from marklens.operators.order import _join_on

    return _join_on(a, b, keys)


def score_distribution(df: DataFrame, score: str, keys: list[str], name: str) -> DataFrame:
    """Score -> count map as compact JSON with ordered keys; scores lie on a fixed grid."""
    from marklens.functions.scalars import score_text

    counts = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.array_sort(F.collect_list(F.struct(score_text(F.col(score)).alias("s"), F.col("_n").alias("n"))))
    return counts.groupBy(*keys).agg(F.to_json(F.map_from_entries(pairs)).alias(name))


def attribute_rows(df: DataFrame, attributes: list[str], keep: list[str]) -> DataFrame:
    """One row per item and attribute; NULL values become ``Missing``."""
    packed = F.array(
        *[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a).cast("string"), F.lit("Missing")).alias("group"))
          for a in attributes]
    )
    return df.select(*keep, F.inline(packed))


def subgroup_table(df: DataFrame, attributes: list[str], small: int = 20) -> DataFrame:
    """Errors and selection behaviour of two queues per value of several attributes, in one pass.

    Expects ``disagreement_selected`` and ``shortest_selected`` flags.
    """
    sets = [[a] for a in attributes]
    hit = F.count_if(F.col("large") & F.col("disagreement_selected"))
    base = df.withColumns({a: F.coalesce(F.col(a).cast("string"), F.lit("Missing")) for a in attributes})
    out = base.groupingSets([[F.col(a) for a in s] for s in sets], *[F.col(a) for a in attributes]).agg(
        F.count(F.lit(1)).alias("n"), F.avg("err_v").alias("mae_v"), F.avg("err_g").alias("mae_g"),
        F.count_if("large").alias("large_count"), F.avg(F.col("large").cast("double")).alias("prevalence"),
        F.count_if("disagreement_selected").alias("disagreement_count"),
        F.avg(F.col("disagreement_selected").cast("double")).alias("disagreement_rate"),
        F.try_divide(hit.cast("double"), F.count_if("large").cast("double")).alias("within_group_capture"),
        F.count_if("shortest_selected").alias("shortest_count"),
        F.avg(F.col("shortest_selected").cast("double")).alias("shortest_rate"),
    )
    label = F.coalesce(*[F.when(F.col(a).isNotNull(), F.lit(a)) for a in attributes])
    out = out.withColumn("attribute", label).withColumn("group", F.coalesce(*[F.col(a) for a in attributes]))
    total = df.select(F.avg(F.col("disagreement_selected").cast("double")).alias("random_expected_rate"))
    out = with_row(out.drop(*attributes), total)
    return out.withColumn("small_n", F.col("n") < small)
