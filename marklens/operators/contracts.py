"""Data contracts: each check is one aggregate that returns counts of violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklens.functions.scalars import SCIENTIFIC_ID
from marklens.operators.order import _join_on, with_row
from marklens.schema import SCORE_MAX, SCORE_MIN


class ContractError(ValueError):
    """Raised when a frame breaks its contract."""


def require(report: DataFrame, ok: Sequence[str] = ()) -> None:
    """Raise if any violation count of a one-row report is positive; ``ok`` names plain facts."""
    row = report.first().asDict()
    bad = {k: v for k, v in row.items() if k not in ok and v not in (0, None, False)}
    if bad:
        raise ContractError(f"contract violated: {bad}")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")


def not_finite(x: str) -> Column:
    v = F.col(x).cast("double")
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))


def items_report(
    df: DataFrame, key: str, text: str | None = None, numeric: Sequence[str] = (), by: Sequence[str] = ()
) -> DataFrame:
    """Rows, NULL and repeated keys, blank texts, non-finite values per numeric column."""
    require_columns(df, [key, *([text] if text else []), *numeric])
    blank = (F.col(text).isNull() | (F.btrim(F.regexp_replace(text, r"(?U)\s+", " ")) == "")) if text else F.lit(False)
    # one row per key first: a key that repeats a million times is then one row with a count
    flags = df.select(*by, F.col(key).alias("_key"), blank.alias("_blank"), *[not_finite(x).alias(x) for x in numeric])
    per = flags.groupBy(*by, "_key").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_blank").alias("_blank"), *[F.count_if(x).alias(x) for x in numeric]
    )
    has_key = F.col("_key").isNotNull()
    return per.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~has_key, F.col("_n"))), F.lit(0)).alias("null_ids"),
        F.coalesce(F.sum(F.when(has_key, F.col("_n") - 1)), F.lit(0)).alias("repeated_ids"),
        F.coalesce(F.sum("_blank"), F.lit(0)).alias("blank_texts"),
        *[F.coalesce(F.sum(x), F.lit(0)).alias(f"bad_{x}") for x in numeric],
    )


def validate_items(df: DataFrame, key: str, text: str, numeric: Sequence[str]) -> DataFrame:
    """Trimmed text and double scores, or an error that lists what is wrong."""
    report = items_report(df, key, text, numeric)
    row = report.first()
    if row["rows"] == 0:
        raise ContractError("empty frame")
    require(report, ok=("rows",))
    return df.withColumns({text: F.btrim(text), **{x: F.col(x).cast("double") for x in numeric}})


def split_gate(df: DataFrame, allowed: Sequence[str], column: str = "split") -> DataFrame:
    """One row per split label with its rows and whether the label is allowed."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("allowed", F.coalesce(F.col(column).isin(list(allowed)), F.lit(False)))


def require_splits(df: DataFrame, allowed: Sequence[str], column: str = "split") -> None:
    bad = split_gate(df, allowed, column).where(~F.col("allowed")).agg(F.sum("rows").alias("forbidden_rows"))
    require(bad)


def population_report(
    features: DataFrame, labels: DataFrame, manifest: DataFrame, key: str, values: Sequence[str], status: str, eligible: str
) -> DataFrame:
    """Agreement of three tables on one population plus completeness and range of the values."""
    tag = lambda df, i: df.select(F.col(key), F.lit(i).alias("_src"))
    ids = tag(features, 1).unionByName(tag(labels, 2)).unionByName(tag(manifest, 4))
    per = ids.groupBy(key).agg(F.bit_or("_src").alias("_in"), F.count(F.lit(1)).alias("_n"))
    sets = per.agg(
        F.count(F.lit(1)).alias("ids"), F.count_if(F.col("_in") != 7).alias("ids_not_everywhere"),
        F.count_if((F.col("_in") == 7) & (F.col("_n") > 3)).alias("repeated_ids"),
    )
    bad = reduce(lambda a, b: a | b, [not_finite(v) | ~F.col(v).cast("double").between(SCORE_MIN, SCORE_MAX) for v in values])
    vals = labels.agg(F.count_if(bad).alias("rows_out_of_range"))
    elig = manifest.agg(F.count_if(F.col(status) == eligible).alias("eligible"))
    return with_row(with_row(sets, vals), elig)


def metadata_report(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Null-safe disagreements per shared column over the common keys."""
    right = b.select(F.col(key), *[F.col(c).alias(f"_b_{c}") for c in columns])
    j = a.select(key, *columns).join(right, key)
    differs = lambda c: ~F.col(c).cast("string").eqNullSafe(F.col(f"_b_{c}").cast("string"))
    return j.agg(F.count(F.lit(1)).alias("common"), *[F.count_if(differs(c)).alias(f"differs_{c}") for c in columns])


def fold_report(df: DataFrame, folds: int, key: str, split: str = "split", fold: str = "cv_fold") -> DataFrame:
    """Folds present in train, fold values outside the range or outside train, keys in two splits."""
    train = F.col(split) == "model_train"
    f = F.col(fold)
    basic = df.agg(
        F.count_distinct(F.when(train, f)).alias("folds_in_train"),
        F.count_if(train & (f.isNull() | ~f.between(0, folds - 1))).alias("bad_train_folds"),
        F.count_if(~train & f.isNotNull()).alias("folds_outside_train"),
    )
    per = df.groupBy(key).agg((F.min(split) != F.max(split)).alias("_both"))
    return with_row(basic, per.agg(F.count_if("_both").alias("ids_in_two_splits")))


def status_counts(df: DataFrame, eligible: str, split: str = "split", status: str = "privacy_review_status") -> DataFrame:
    return df.groupBy(split, status).agg(F.count(F.lit(1)).alias("rows")).withColumn("kept", F.col(status) == eligible)


def keep_eligible(df: DataFrame, eligible: str, status: str = "privacy_review_status") -> DataFrame:
    return df.where(F.col(status) == eligible)


def leakage_report(df: DataFrame, key: str, content: Column, split: str) -> DataFrame:
    """Keys and contents that occur in more than one split (a hot content is one row per split)."""
    def crossing(what: Column, name: str) -> DataFrame:
        pairs = df.select(what.alias("_x"), F.col(split).alias("_s")).distinct()
        per = pairs.groupBy("_x").agg(F.count(F.lit(1)).alias("_k"))
        return per.agg(F.count_if(F.col("_k") > 1).alias(name))

    return with_row(crossing(F.col(key), "ids_in_two_splits"), crossing(content, "contents_in_two_splits"))


def group_composition(df: DataFrame, fold: str, group: str) -> DataFrame:
    """Rows of each group in a fold and outside it; disjoint when the second is 0."""
    per = df.groupBy(group, fold).agg(F.count(F.lit(1)).alias("held_out"))
    total = per.groupBy(group).agg(F.sum("held_out").alias("_all"))
    j = _join_on(per, total, [group])
    return j.select(fold, group, "held_out", (F.col("_all") - F.col("held_out")).alias("in_training"), (F.col("_all") == F.col("held_out")).alias("disjoint"))


def tolerance_report(
    a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Mapping[str, str] | Sequence[str], tol: float
) -> DataFrame:
    """Largest absolute difference and rows beyond the tolerance per column, with unmatched keys."""
    pairs = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    left = a.select(*keys, *[F.col(x).cast("double").alias(f"_a_{x}") for x in pairs], F.lit(True).alias("_l"))
    right = b.select(*keys, *[F.col(y).cast("double").alias(f"_b_{x}") for x, y in pairs.items()], F.lit(True).alias("_r"))
    j = left.join(right, list(keys), "full_outer")
    gap = {x: F.abs(F.col(f"_a_{x}") - F.col(f"_b_{x}")) for x in pairs}
    rows = F.array(
        *[F.struct(F.lit(x).alias("column"), F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("unmatched"),
                   F.max(g).alias("max_difference"), F.count_if(g > tol).alias("beyond_tolerance"))
          for x, g in gap.items()]
    )
    return j.agg(rows.alias("x")).select(F.inline("x"))


def scientific_ids(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).cast("string").rlike(SCIENTIFIC_ID)).alias("scientific_ids"))


def form_errors(rules: Mapping[str, Column]) -> Column:
    """All broken rules of a form row, in order; a rule that cannot be decided counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def stored_metrics_report(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], values: Sequence[str], tol: float) -> DataFrame:
    """Stored metric rows against recomputed ones: one row per key, values within tolerance."""
    once = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("repeated_keys"))
    return with_row(tolerance_report(stored, fresh, keys, list(values), tol), once)
