"""Checked joins and set operations on keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklens.operators.contracts import ContractError, keep_eligible, require_columns
from marklens.operators.order import with_row
from marklens.schema import ELIGIBLE_STATUS


def with_status(items: DataFrame, raters: DataFrame, key: str, flags: Sequence[str], missing: str = "unresolved_raw_id_link") -> DataFrame:
    """Status per item: flagged if any flag is 1, else not flagged; ``missing`` without a rater row.

    Raters collapse to one row per key before the join, so repeated rater rows cannot multiply items.
    """
    any_flag = F.greatest(*[F.coalesce((F.col(f) == 1).cast("int"), F.lit(0)) for f in flags]) if len(flags) > 1 else F.coalesce((F.col(flags[0]) == 1).cast("int"), F.lit(0))
    status = raters.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(any_flag).alias("_flag"))
    out = items.join(status, key, "left")
    text = F.when(F.col("_flag") == 1, "flagged").when(F.col("_flag") == 0, "not_flagged").otherwise(missing)
    return out.withColumn("privacy_review_status", text).drop("_flag")


def key_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys on each side, common, one-sided, and repeated keys, from one grouped union."""
    both = a.select(F.col(key).alias("_k"), F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(
        b.select(F.col(key).alias("_k"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    per = both.groupBy("_k").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    l, r = F.col("_a") > 0, F.col("_b") > 0
    return per.agg(
        F.count_if(l).alias("left_ids"), F.count_if(r).alias("right_ids"), F.count_if(l & r).alias("common"),
        F.count_if(l & ~r).alias("only_left"), F.count_if(~l & r).alias("only_right"),
        F.count_if(F.col("_a") > 1).alias("repeated_left"), F.count_if(F.col("_b") > 1).alias("repeated_right"),
    )


def one_to_one(a: DataFrame, b: DataFrame, key: str, finite: Sequence[str] = ()) -> DataFrame:
    """Inner join that refuses repeated keys, unequal key sets and non-finite values."""
    rep = key_report(a, b, key).first()
    if rep["repeated_left"] or rep["repeated_right"]:
        raise ContractError("keys repeat on one side of a one-to-one join")
    if rep["only_left"] or rep["only_right"]:
        raise ContractError("key sets differ in a one-to-one join")
    out = a.join(b, key)
    if finite:
        from marklens.operators.contracts import not_finite, require

        require(out.agg(*[F.count_if(not_finite(x)).alias(x) for x in finite]))
    return out


def left_complete(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left join that must neither multiply nor leave unmatched rows."""
    dup = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    if not dup.isEmpty():
        raise ContractError("right side of a one-to-one join repeats a key")
    out = a.join(b.select(*keys, *values, F.lit(True).alias("_hit")), list(keys), "left")
    if not out.where(F.col("_hit").isNull()).isEmpty():
        raise ContractError("left join leaves rows without a match")
    return out.drop("_hit")


def left_gaps(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before and after a left join on several keys, and rows without a match."""
    hit = b.select(*keys).distinct().withColumn("_hit", F.lit(True))
    out = a.select(*keys).join(hit, list(keys), "left")
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_hit").isNull()).alias("unmatched"))


def suffixed(a: DataFrame, b: DataFrame, key: str, shared: Sequence[str], suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """Inner join of frames with overlapping column names."""
    l = a.select(key, *[F.col(c).alias(c + suffixes[0]) for c in shared])
    r = b.select(key, *[F.col(c).alias(c + suffixes[1]) for c in shared])
    return l.join(r, key)


def prepare_training(
    features: DataFrame, manifest: DataFrame, key: str, feature_columns: Sequence[str], eligible: str = ELIGIBLE_STATUS
) -> tuple[DataFrame, DataFrame]:
    """Join features to the manifest and return the eligible train and validation rows."""
    from marklens.operators.contracts import fold_report, metadata_report, require

    require_columns(features, [key, "split", "cv_fold", *feature_columns])
    require(metadata_report(features, manifest, key, ["split", "cv_fold"]), ok=("common",))
    joined = one_to_one(features, manifest.select(key, "privacy_review_status"), key, feature_columns)
    dev = keep_eligible(joined, eligible).where(F.col("split").isin("model_train", "validation"))
    require(fold_report(dev, 5, key), ok=("folds_in_train",))
    return dev.where("split = 'model_train'"), dev.where("split = 'validation'")


def anchor_overlap(a: Column, b: Column) -> list[Column]:
    return [
        F.count_if(a).alias("first"), F.count_if(b).alias("second"), F.count_if(a & b).alias("both"),
        F.count_if(a | b).alias("either"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"),
    ]


def fixed_by_new(df: DataFrame, fold: str, old_shared: Column, new_error: Column, threshold: float) -> DataFrame:
    """Old shared errors that stay, get fixed or sit on the threshold, per fold and pooled."""
    out = df.where(old_shared).rollup(fold).agg(
        F.count(F.lit(1)).alias("old_shared"), F.count_if(new_error > threshold).alias("still_wrong"),
        F.count_if(new_error < threshold).alias("fixed"), F.count_if(new_error == threshold).alias("at_threshold"),
        F.grouping(fold).alias("_g"),
    )
    scope = F.when(F.col("_g") == 1, "pooled").otherwise(F.col(fold).cast("string"))
    return out.withColumn("scope", scope).drop("_g", fold)
