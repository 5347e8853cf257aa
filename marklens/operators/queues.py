"""Review queues: signals as strategies, budgets, metrics over grids, subgroups under random queues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklens.functions.draws import hypergeometric_draws, uniform
from marklens.functions.metrics import queue_columns, safe_ratio
from marklens.operators.order import budget_size, quantiles, rank_rows, with_row
from marklens.schema import BUDGETS, PRIMARY_BUDGET, THRESHOLDS
from marklens.session import materialise


def linear_centres(reference: DataFrame) -> DataFrame:
    """One row: medians of the linear predictions over a reference population."""
    v = quantiles(reference, "lin_v", {"centre_v": 0.5})
    g = quantiles(reference, "lin_g", {"centre_g": 0.5})
    return with_row(v, g)


def extremity(a: Column, b: Column, centre_a: Column, centre_b: Column) -> Column:
    return F.greatest(F.abs(a - centre_a), F.abs(b - centre_b))


def strategy_scores(df: DataFrame, strategies: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One narrow row per item and strategy; a higher score is reviewed earlier."""
    packed = F.array(
        *[F.struct(F.lit(n).alias("strategy"), s.cast("double").alias("score")) for n, s in strategies.items()]
    )
    return df.select(*keep, F.inline(packed))


def ranked_strategies(
    df: DataFrame, strategies: Mapping[str, Column], keep: Sequence[str], partition: Sequence[str] = (),
    segments: int | None = None,
) -> DataFrame:
    """Rank every strategy in one sort: score descending, ties by the item id as text."""
    rows = strategy_scores(df, strategies, ["item_id", *keep])
    return rank_rows(
        rows, [F.desc("score"), "item_id"], ["strategy", *partition], "rank", "group_n", segments
    )


def standard_strategies(with_centres: bool = True) -> dict[str, Column]:
    out = {"disagreement": F.col("d_max"), "shortest_first": -F.col("word_count")}
    if with_centres:
        out["extremity"] = extremity(F.col("lin_v"), F.col("lin_g"), F.col("centre_v"), F.col("centre_g"))
    return out


def select_budget(ranked: DataFrame, budget: float = PRIMARY_BUDGET) -> DataFrame:
    return ranked.withColumn("queue_size", budget_size("group_n", budget)).withColumn(
        "selected", F.col("rank") <= F.col("queue_size")
    )


def queue_metrics(df: DataFrame, by: Sequence[str], large: Column | None = None, selected: Column | None = None) -> DataFrame:
    cols = queue_columns(F.col("large") if large is None else large, F.col("selected") if selected is None else selected)
    return df.groupBy(*by).agg(*[v.alias(k) for k, v in cols.items()])


def sensitivity_grid(
    ranked: DataFrame, thresholds: Sequence[float] = THRESHOLDS, budgets: Sequence[float] = BUDGETS,
    by: Sequence[str] = ("strategy",), primary: tuple[float, float] = (1.0, PRIMARY_BUDGET),
) -> DataFrame:
    """Queue metrics for every threshold and budget from one pass over the items.

    Items collapse to (strategy, thresholds passed, tightest budget reached) cells before the grid
    is opened, so the grid size does not multiply the rows that are read.
    """
    ts, bs = sorted(thresholds), sorted(budgets)
    passed = sum(((F.col("max_err") >= t).cast("int") for t in ts), F.lit(0))
    reached = sum(((F.col("rank") <= budget_size("group_n", b)).cast("int") for b in bs), F.lit(0))
    cells = ranked.groupBy(*by, passed.alias("_t"), reached.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    grid = F.array(
        *[
            F.struct(F.lit(t).alias("threshold"), F.lit(b).alias("budget"),
                     (F.col("_t") > i).alias("_large"), (F.col("_b") >= len(bs) - j).alias("_sel"))
            for i, t in enumerate(ts) for j, b in enumerate(bs)
        ]
    )
    rows = cells.select(*by, "_n", F.inline(grid))
    count = lambda cond: F.sum(F.when(cond, F.col("_n")).otherwise(0))
    out = rows.groupBy(*by, "threshold", "budget").agg(
        F.sum("_n").alias("n"), count(F.col("_sel")).alias("selected_count"), count(F.col("_large")).alias("positives"),
        count(F.col("_large") & F.col("_sel")).alias("captured"),
    )
    return out.withColumns(
        {
            "capture_rate": safe_ratio(F.col("captured"), F.col("positives")),
            "precision": safe_ratio(F.col("captured"), F.col("selected_count")),
            "lift": F.try_divide(
                F.try_divide(F.col("captured").cast("double") * F.col("n"), F.col("selected_count").cast("double")),
                F.col("positives").cast("double")),
            "primary": (F.col("threshold") == primary[0]) & (F.col("budget") == primary[1]),
        }
    )


def overlap(df: DataFrame, a: Column, b: Column, positive: Column) -> list[Column]:
    """Intersection, Jaccard and positives in the four cells of two queues."""
    both, either = F.count_if(a & b), F.count_if(a | b)
    return [
        both.alias("both"), safe_ratio(both, F.count_if(a)).alias("fraction_of_a"), safe_ratio(both, either).alias("jaccard"),
        F.count_if(a & b & positive).alias("positives_both"), F.count_if(a & ~b & positive).alias("positives_only_a"),
        F.count_if(~a & b & positive).alias("positives_only_b"), F.count_if(~a & ~b & positive).alias("positives_neither"),
    ]


def error_quadrants(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """High/low disagreement (at or above the population median, or a frozen value) by large/other."""
    if threshold is None:
        df = with_row(df, quantiles(df, "d_max", {"_m": 0.5}))
    else:
        df = df.withColumn("_m", F.lit(float(threshold)))
    high = F.when(F.col("d_max") >= F.col("_m"), "high_d").otherwise("low_d")
    size = F.when(F.col("large"), "large").otherwise("other")
    return df.withColumn("quadrant", F.concat_ws("_", high, size)).drop("_m")


def cutoff_audit(selected: DataFrame, score: str) -> DataFrame:
    """Positives below, at and above the score of the last queue member, and the best possible catch."""
    k = selected.where(F.col("rank") == F.col("queue_size")).select("queue_size", F.col(score).alias("cutoff"))
    rows = with_row(selected.drop("queue_size"), k)
    s, big = F.col(score), F.col("large")
    out = rows.groupBy("queue_size", "cutoff").agg(
        F.count_if("large").alias("positives"), F.count_if(big & (s < F.col("cutoff"))).alias("below"),
        F.count_if(big & (s == F.col("cutoff"))).alias("equal"), F.count_if(big & (s > F.col("cutoff"))).alias("above"),
        F.count_if(big & F.col("selected")).alias("caught"),
    )
    return out.withColumn("optimistic_cap", F.least("queue_size", F.col("equal") + F.col("above")))


def subgroup_random_capture(
    df: DataFrame, attributes: Sequence[str], draws: int, budget: float, seed: int, minimum: int = 20, few: int = 10
) -> DataFrame:
    """Queue and mean random queue inside each subgroup, one row per attribute and group.

    Expects flags ``large`` and ``selected``.  A global random queue of ``ceil(budget * n)`` items falls into the cells
    (group, label) of an attribute by the multivariate hypergeometric law; it is drawn cell after cell from what is
    left, in the order of group and label, each draw once for all cells.  Groups under ``minimum`` are listed without
    figures, groups with fewer than ``few`` positives carry a note.  The cells of an attribute are few and one array.
    """
    packed = F.inline(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("grp")) for a in attributes]))
    per = df.select("large", "selected", packed).groupBy("attribute", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("large").alias("positives"), F.count_if("selected").alias("selected"),
        F.count_if(F.col("large") & F.col("selected")).alias("caught"),
    )
    per = materialise(per, "subgroups")
    cells = per.groupBy("attribute").agg(F.sort_array(F.collect_list(F.struct("grp", "n", "positives"))).alias("cells"))
    number = F.array_position(F.lit(list(attributes)), F.col("attribute"))
    rows = cells.select("attribute", number.alias("at"), "cells", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))

    @F.pandas_udf("array<struct<grp: string, drawn: bigint, hit: bigint>>")
    def drawn(at: pd.Series, cells: pd.Series, draw: pd.Series) -> pd.Series:
        out = [None] * len(at)
        for number, rows in at.groupby(at).groups.items():
            places = at.index.get_indexer(rows)
            groups = cells.loc[rows[0]]
            rep = draw.loc[rows].to_numpy()
            left = np.full(len(rows), sum(g["n"] for g in groups))
            open_ = np.ceil(left * budget).astype(np.int64)
            got = []
            for i, g in enumerate(groups):
                took = []
                for label, size in ((0, g["n"] - g["positives"]), (1, g["positives"])):
                    key = np.full(len(rows), (number * 1_000_003 + i) * 2 + label)
                    x = hypergeometric_draws(left, np.full(len(rows), size), open_, uniform(key, rep, seed))
                    left, open_ = left - size, open_ - x
                    took.append(x)
                got.append(took)
            for r, place in enumerate(places):
                out[place] = [{"grp": g["grp"], "drawn": int(t[0][r] + t[1][r]), "hit": int(t[1][r])} for g, t in zip(groups, got)]
        return pd.Series(out)

    spread_rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism, "draw")
    means = spread_rows.select("attribute", F.inline(drawn("at", "cells", "draw"))).groupBy("attribute", "grp").agg(
        F.avg("hit").alias("random_mean_caught"), F.avg("drawn").alias("random_mean_selected")
    )
    same = (F.col("p.attribute") == F.col("m.attribute")) & F.col("p.grp").eqNullSafe(F.col("m.grp"))
    out = per.alias("p").join(means.alias("m"), same).select("p.*", "random_mean_caught", "random_mean_selected")
    shown = F.col("n") >= minimum
    told = {
        "caught": F.col("caught"), "selected": F.col("selected"), "capture": safe_ratio(F.col("caught"), F.col("positives")), "selection_rate": safe_ratio(F.col("selected"), F.col("n")),
        "random_mean_caught": F.col("random_mean_caught"), "random_mean_capture": F.try_divide(F.col("random_mean_caught"), F.col("positives").cast("double")),
        "random_mean_selected": F.col("random_mean_selected"), "random_mean_rate": F.col("random_mean_selected") / F.col("n"),
        "note": F.when(F.col("positives") < few, F.lit("few positives")).otherwise(F.lit("descriptive")),
    }
    return out.select("attribute", "grp", "n", "positives", shown.alias("reported"), *[F.when(shown, v).alias(k) for k, v in told.items()])


def top_per_group(df: DataFrame, by: Sequence[str], score: Column, key: str, k: int) -> DataFrame:
    """The ``k`` highest rows per group, ties by key; ``k`` is a small report size.

    A salted first pass keeps ``k`` rows per (group, salt), so a hot group is never one task.
    """
    from pyspark.sql import Window

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))
    first = Window.partitionBy(*by, "_salt").orderBy(score.desc(), F.col(key))
    best = salted.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= k).drop("_salt")
    last = Window.partitionBy(*by).orderBy(score.desc(), F.col(key))
    return best.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= k).drop("_k")


def prioritise(df: DataFrame, budget: float, threshold: float) -> DataFrame:
    """Nested batch result: scores, disagreement, reasons, rank and ``review_first``.

    A zero budget selects nothing and an empty input gives an empty result.
    """
    from marklens.functions.scalars import consensus, reasons
    from marklens.operators.signals import add_signals

    if isinstance(budget, bool) or not (isinstance(budget, (int, float)) and 0 <= budget <= 1):
        raise ValueError("review budget must be a number in [0, 1]")
    s = add_signals(df.select("item_id", "y_v", "y_g", "lin_v", "lin_g", "for_v", "for_g"))
    ranked = rank_rows(s.select("item_id", "lin_v", "lin_g", "for_v", "for_g", "d_v", "d_g", "d_max"), [F.desc("d_max"), "item_id"])
    side = lambda t: F.struct(
        F.col(f"lin_{t}").alias("linear"), F.col(f"for_{t}").alias("forest"),
        consensus(F.col(f"lin_{t}"), F.col(f"for_{t}")).alias("consensus"),
    )
    return ranked.select(
        "item_id",
        F.struct(side("v").alias("vocabulary"), side("g").alias("grammar")).alias("scores"),
        F.struct(F.col("d_v").alias("vocabulary"), F.col("d_g").alias("grammar"), F.col("d_max").alias("maximum")).alias("disagreement"),
        reasons({"vocabulary": F.col("d_v") >= threshold, "grammar": F.col("d_g") >= threshold}).alias("reasons"),
        "rank", (F.col("rank") <= budget_size("group_n", budget)).alias("review_first"),
    )


def best_strategies(metrics: DataFrame) -> DataFrame:
    """Highest capture rate with every strategy that reaches it (one row per strategy goes in)."""
    best = metrics.agg(F.max("capture_rate").alias("best_capture"))
    rows = with_row(metrics, best).where(F.col("capture_rate") == F.col("best_capture"))
    return rows.groupBy("best_capture").agg(F.array_join(F.array_sort(F.collect_list("strategy")), ",").alias("strategies"))


def quadrant_shares(df: DataFrame) -> DataFrame:
    """Large/other against below / at-or-above the median disagreement, as counts and row shares."""
    from pyspark.sql import Window

    s = with_row(df, quantiles(df, "d_max", {"_m": 0.5}))
    g = F.when(F.col("d_max") < F.col("_m"), "below").otherwise("at_or_above")
    counts = s.groupBy("large", g.alias("d_group")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("large")  # two rows each
    counts = counts.withColumn("row_total", F.sum("n").over(w))
    return counts.withColumn("fraction", F.col("n") / F.col("row_total"))
