"""Leakage-safe splits, folds and small review samples in a seeded order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marklens.operators.order import lookup, rank_by_key, rank_rows, seeded_key
from marklens.session import materialise


def duplicate_groups(df: DataFrame, content: Column, stratum: str) -> DataFrame:
    """One row per content hash: size, distinct strata and the modal stratum (smallest on ties).

    Counts per (hash, stratum) come first, so a content shared by a third of the rows arrives as a
    few rows.
    """
    per = df.select(content.alias("content_hash"), F.col(stratum).alias("_s")).groupBy("content_hash", "_s").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return per.groupBy("content_hash").agg(
        F.sum("_n").alias("group_size"), F.count(F.lit(1)).alias("strata"),
        F.min_by("_s", F.struct(-F.col("_n"), F.col("_s"))).alias("stratum"),
    )


def holdout_groups(groups: DataFrame, share: float, seed: int | str) -> DataFrame:
    """``validation`` for the first ``ceil(share * n)`` groups of every stratum in seeded order."""
    keyed = groups.withColumn("_key", seeded_key(seed, "content_hash"))
    ranked = rank_by_key(keyed, "_key", "content_hash", ["stratum"])
    held = F.col("rank") <= F.ceil(F.col("group_n").cast("double") * F.lit(share))
    return ranked.withColumn("split", F.when(held, "validation").otherwise("model_train")).drop("_key", "rank", "group_n")


def fold_groups(groups: DataFrame, folds: int, seed: int | str) -> DataFrame:
    """Fold 0..k-1 per train group, dealt round-robin inside every stratum; NULL elsewhere."""
    train = groups.where("split = 'model_train'").withColumn("_key", seeded_key(seed, "content_hash"))
    ranked = rank_by_key(train, "_key", "content_hash", ["stratum"])
    dealt = ranked.withColumn("cv_fold", ((F.col("rank") - 1) % folds).cast("int")).drop("_key", "rank", "group_n")
    rest = groups.where("split <> 'model_train'").withColumn("cv_fold", F.lit(None).cast("int"))
    return dealt.unionByName(rest)


def assign(df: DataFrame, content: Column, stratum: str, share: float, folds: int, seed: int | str) -> DataFrame:
    """Split and fold per row; equal contents always share both.

    A content that a third of the rows share is spread over salted tasks.
    """
    groups = fold_groups(holdout_groups(duplicate_groups(df, content, stratum), share, seed), folds, f"{seed}-fold")
    groups = materialise(groups.select("content_hash", "split", "cv_fold"), "groups")
    rows = df.withColumn("content_hash", content).where(F.col("content_hash").isNotNull())
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return lookup(rows, groups, "content_hash", plain)


def snake_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """Folds 1..k per group, balanced by size: largest first, dealt back and forth."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    ranked = rank_rows(sizes, [F.desc("group_size"), group])
    turn = (F.col("rank") - 1) % (2 * folds)
    fold = F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn) + 1
    return ranked.select(group, "group_size", fold.cast("int").alias("fold"))


def plain_folds(df: DataFrame, key: str, folds: int, seed: int | str) -> DataFrame:
    """Shuffled k-fold with sizes equal within one."""
    keyed = df.withColumn("_key", seeded_key(seed, key))
    ranked = rank_by_key(keyed, "_key", key)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % folds).cast("int")).drop("_key", "rank", "group_n")


def fold_summary(df: DataFrame, fold: str, group: str, values: Sequence[str]) -> DataFrame:
    """Fit and holdout rows, groups in the holdout, and means on both sides of each fold.

    Sums per fold are enough; the complement is total minus holdout.
    """
    sums = df.groupBy(fold).agg(F.count(F.lit(1)).alias("holdout_rows"), *[F.sum(v).alias(f"_s_{v}") for v in values])
    groups = df.groupBy(fold).agg(F.count_distinct(group).alias("holdout_groups"))
    w = Window.partitionBy()  # one row per fold
    n_all = F.sum("holdout_rows").over(w)
    cols = [(n_all - F.col("holdout_rows")).alias("fit_rows")]
    for v in values:
        cols += [
            ((F.sum(f"_s_{v}").over(w) - F.col(f"_s_{v}")) / (n_all - F.col("holdout_rows"))).alias(f"{v}_fit_mean"),
            (F.col(f"_s_{v}") / F.col("holdout_rows")).alias(f"{v}_holdout_mean"),
        ]
    return sums.join(groups, fold).select(fold, "holdout_rows", "holdout_groups", *cols)


def level_balance(df: DataFrame, level: Column, first: str, second: str, split: str = "split") -> DataFrame:
    """Counts and shares of every level in two splits and their difference in percentage points."""
    a, b = F.col(split) == first, F.col(split) == second
    counts = df.where(a | b).groupBy(level.alias("level")).agg(F.count_if(a).alias("first_count"), F.count_if(b).alias("second_count"))
    total = counts.agg(F.sum("first_count").alias("_a"), F.sum("second_count").alias("_b"))
    from marklens.operators.order import with_row

    out = with_row(counts, total)
    pa, pb = 100.0 * F.col("first_count") / F.col("_a"), 100.0 * F.col("second_count") / F.col("_b")
    return out.select("level", "first_count", "second_count", pa.alias("first_percent"), pb.alias("second_percent"), F.abs(pa - pb).alias("gap"))


# ---- small review samples -----------------------------------------------------------------------

def first_rows(df: DataFrame, order: Sequence, k: int) -> DataFrame:
    """A fixed small number of rows; a top-k operator keeps ``k`` rows per task."""
    return df.orderBy(*order).limit(k)


def quota_sample(df: DataFrame, key: str, rules: Sequence[tuple[str, list]], quota: int, cap: int, seed: int | str) -> DataFrame:
    """Quotas by rules in order, no item twice, the rest in seeded order up to ``cap``.

    Every list is at most ``cap`` plus the rules' picks long, whatever the table holds.
    """
    lists = []
    for i, (reason, order) in enumerate(rules):
        top = first_rows(df, order, quota).select(key, F.lit(reason).alias("reason"), F.lit(i).alias("_p"))
        lists.append(top)
    picked = lists[0]
    for t in lists[1:]:
        picked = picked.unionByName(t)
    first = picked.groupBy(key).agg(F.min_by("reason", "_p").alias("reason"), F.min("_p").alias("_p"))
    spare = first_rows(df.withColumn("_key", seeded_key(seed, key)), ["_key", key], cap + quota * len(rules))
    spare = spare.select(key, "_key").join(F.broadcast(first.select(key)), key, "left_anti")
    rest = spare.select(key, F.lit("seeded_random").alias("reason"), F.lit(len(rules)).alias("_p"), "_key")
    pool = first.withColumn("_key", F.lit("")).unionByName(rest)
    return first_rows(pool, ["_p", "_key", key], cap).select(key, "reason")


def exclusive_samples(df: DataFrame, key: str, steps: Sequence[tuple[str, Column, list, int]]) -> DataFrame:
    """Named samples one after another: predicate, order and size; earlier picks are left out.

    A step looks at its own quota plus everything picked before, which bounds each list, and its few picks are
    written, so that each step reads the items once.
    """
    taken = None
    out = None
    before = 0
    for name, cond, order, k in steps:
        pool = first_rows(df.where(cond), order, k + before)
        if taken is not None:
            pool = pool.join(F.broadcast(taken), key, "left_anti")
        step = materialise(first_rows(pool, order, k).withColumn("sample", F.lit(name)), "sample")
        out = step if out is None else out.unionByName(step)
        ids = step.select(key)
        taken = ids if taken is None else taken.unionByName(ids)
        before += k
    return out


def band_sample(df: DataFrame, key: str, band: str, per_band: int, seed: int | str, used: Column | None = None) -> DataFrame:
    """``per_band`` items of every band in seeded order, unused items first; a second seeded order
    numbers the chosen items anonymously."""
    flag = F.lit("0") if used is None else F.when(used, "1").otherwise("0")
    keyed = df.withColumn("_key", F.concat(flag, seeded_key(seed, key)))
    ranked = rank_by_key(keyed, "_key", key, [band], digits=4)
    chosen = ranked.where(F.col("rank") <= per_band).drop("_key", "rank", "group_n")
    chosen = chosen.withColumn("_order", seeded_key(f"{seed}-order", key))
    return rank_by_key(chosen, "_order", key, rank="reading_order").drop("_order", "group_n")


def anonymous_code(prefix: str, number: Column) -> Column:
    return F.format_string(prefix + "_%02d", number)


def nearest_to_median(df: DataFrame, key: str, value: str) -> DataFrame:
    from marklens.operators.order import quantiles, with_row

    rows = with_row(df, quantiles(df, value, {"median": 0.5}))
    return first_rows(rows.withColumn("gap", F.abs(F.col(value) - F.col("median"))), ["gap", key], 1)
