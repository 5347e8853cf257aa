"""Bootstraps by replicate weights.

Items with equal values are one cell, and a cell of m items weighs Poisson(m) in a replicate, which is the law of its
items' own Poisson(1) weights.  Weights are a function of (seed, replicate, cell), so every signal sees the same draw
and a lost task draws the same again.  No row per item and replicate is shuffled:

* sums of weighted columns leave a task as one row per group and replicate (``replicate_sums``);
* the area under the ROC curve needs the order of the scores only: a range sort deals the cells to segments, each
  segment leaves its weights and its own area per replicate, and the segments are joined up by their order
  (``replicate_auroc``); a score that many cells share may be cut over segments;
* ranks on two sides at once are taken by tasks that each hold the cells and a block of replicates, as long as a count
  shows that the cells are few.  Beyond that the cells are dealt: columns of few values are ranked by the weights of their
  values, one pass for the ranks and one for the products (``spearman_bootstrap``); else rows per replicate are ranked by
  range sorts (``spearman_bootstrap``, ``agreement_bootstrap``).

Replicate 0 is the sample itself and gives the estimates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklens.functions.draws import poisson_weights
from marklens.functions.metrics import pearson
from marklens.operators.order import quantiles, rank_rows, seeded_key, spearman, spread
from marklens.session import materialise

#: Weights that a task holds at once.
BLOCK = 1 << 21
#: Cells that every task may hold.
CELLS = 1_000_000
#: Ranks, values by replicates, that every task may hold, and replicates whose ranks one task takes.
RANKS = 1 << 23
RANKED = 128


def uniform(seed: int | str, *parts: str | Column) -> Column:
    """Uniform in [0, 1) from the first eight hex digits of an md5 key."""
    return F.conv(F.substring(seeded_key(seed, *parts), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def cells(df: DataFrame, columns: Mapping[str, Column], key: str = "item_no") -> DataFrame:
    """One written row per combination of the columns: its items ``m`` and the smallest of their numbers as its key."""
    rows = df.select(*[v.alias(k) for k, v in columns.items()], F.col(key).cast("long").alias("key"))
    return materialise(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("key")), "cells")


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f"{f.name} {f.dataType.simpleString()}, " for n in names for f in df.schema.fields if f.name == n)


def _weighted(pdf: pd.DataFrame, reps: int, seed: int, block: int = BLOCK) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    step = max(1, block // (reps + 1))
    for i in range(0, len(pdf), step):
        part = pdf.iloc[i : i + step]
        yield part, poisson_weights(part["key"].to_numpy(), part["m"].to_numpy(), np.arange(reps + 1), seed)


def replicate(cells: DataFrame, reps: int, seed: int) -> DataFrame:
    """Rows of the cells per replicate with their weight ``w`` > 0: the exact way when nothing smaller will do."""
    names = [c for c in cells.columns if c not in ("m", "key")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, w in _weighted(pdf, reps, seed):
                row, rep = np.nonzero(w)
                yield part[names].iloc[row].assign(rep=rep, w=w[row, rep].astype(np.int64))

    return spread(cells, "key").mapInPandas(run, f"{_fields(cells, names)}rep int, w bigint")


def replicate_sums(cells: DataFrame, by: Sequence[str], sums: Mapping[str, Column], reps: int, seed: int) -> DataFrame:
    """Weighted sums of the columns per group and replicate, null-free; groups are few."""
    rows = spread(cells, "key").select(*by, "m", "key", *[v.cast("double").alias(k) for k, v in sums.items()])
    names, by = list(sums), list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for part, w in _weighted(pdf, reps, seed):
                groups = part.groupby(by, dropna=False, sort=False).indices if by else {(): np.arange(len(part))}
                for group, at in groups.items():
                    group = group if isinstance(group, tuple) else (group,)
                    got = part[names].to_numpy()[at].T @ w[at]
                    total[group] = total[group] + got if group in total else got
        for group, got in total.items():
            out = pd.DataFrame(got.T, columns=names)
            for k, v in zip(by, group):
                out[k] = v
            yield out.assign(rep=np.arange(reps + 1, dtype=np.int32))[[*by, "rep", *names]]

    found = rows.mapInPandas(run, f"{_fields(rows, by)}rep int, " + ", ".join(f"{n} double" for n in names))
    return found.groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in names])


class _Segment:
    """Weights and area of the scores of one group inside one segment, replicate by replicate.

    The first and the last score may go on in the neighbouring segments, so they stay apart as ties.
    """

    def __init__(self, reps: int):
        self.first = self.open = None  # (score, positives, negatives)
        self.low, self.pos, self.neg, self.area = None, np.zeros(reps + 1), np.zeros(reps + 1), np.zeros(reps + 1)

    def add(self, score: np.ndarray, large: np.ndarray, w: np.ndarray) -> None:
        start = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        pos, neg = np.add.reduceat(w * large[:, None], start), np.add.reduceat(w * ~large[:, None], start)
        score = score[start]
        if self.open and self.open[0] == score[0]:
            pos[0] += self.open[1]
            neg[0] += self.open[2]
        elif self.open:
            score, pos, neg = np.r_[self.open[0], score], np.vstack([self.open[1], pos]), np.vstack([self.open[2], neg])
        self.open = (score[-1], pos[-1], neg[-1])
        score, pos, neg = score[:-1], pos[:-1], neg[:-1]
        if len(score) and not self.first:
            self.first = (score[0], pos[0], neg[0])
            score, pos, neg = score[1:], pos[1:], neg[1:]
        if len(score):
            self.low = score[0] if self.low is None else self.low
            before = self.neg + np.cumsum(neg, 0) - neg
            self.area += (pos * (before + neg / 2)).sum(0)
            self.pos, self.neg = self.pos + pos.sum(0), self.neg + neg.sum(0)

    def rows(self) -> Iterator[pd.DataFrame]:
        rep = np.arange(len(self.pos), dtype=np.int32)
        for tie in (self.first, self.open):
            if tie:
                yield pd.DataFrame({"score": tie[0], "tie": True, "rep": rep, "pos": tie[1], "neg": tie[2], "area": 0.0})
        if self.low is not None:
            yield pd.DataFrame({"score": self.low, "tie": False, "rep": rep, "pos": self.pos, "neg": self.neg, "area": self.area})


def replicate_auroc(rows: DataFrame, by: Sequence[str], reps: int, seed: int, segments: int | None = None) -> DataFrame:
    """``auroc`` of ``score`` for ``large`` per group and replicate; NULL when one class is absent.

    ``rows`` are cells (m, key) with a score; rows without a score are left out.
    """
    by = list(by)
    narrow = rows.where("score is not null").select(*by, F.col("score").cast("double").alias("score"), "large", "m", "key")
    n = segments or max(narrow.sparkSession.sparkContext.defaultParallelism, int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = narrow.repartitionByRange(n, *by, "score", "key").sortWithinPartitions(*by, "score", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None

        def out():
            for r in held.rows() if held else ():
                for k, v in zip(by, now):
                    r[k] = v
                yield r[[*by, "score", "tie", "rep", "pos", "neg", "area"]]

        for pdf in batches:
            for part, w in _weighted(pdf, reps, seed):
                codes = part.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(part), int)
                for i, j in zip(cut := np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]), [*cut[1:], len(part)]):
                    group = tuple(part.iloc[i][by]) if by else ()
                    if held is None or group != now:
                        yield from out()
                        now, held = group, _Segment(reps)
                    held.add(part["score"].to_numpy()[i:j], part["large"].to_numpy().astype(bool)[i:j], w[i:j])
        yield from out()

    parts = dealt.mapInPandas(run, f"{_fields(narrow, by)}score double, tie boolean, rep int, pos double, neg double, area double")
    merged = parts.groupBy(*by, "score", "tie", "rep").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "area")])
    below = Window.partitionBy(*by, "rep").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    merged = merged.withColumn("before", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    own = F.when(F.col("tie"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("area"))
    out = merged.groupBy(*by, "rep").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(own + F.col("pos") * F.col("before")).alias("u"))
    return out.select(*by, "rep", F.try_divide(F.col("u"), F.col("positives") * F.col("negatives")).alias("auroc"))


def signals_of(cells: DataFrame, signals: Mapping[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """The cells once per signal with its ``score``."""
    packed = F.array(*[F.struct(F.lit(n).alias("signal"), s.cast("double").alias("score")) for n, s in signals.items()])
    return cells.select(*keep, "large", "m", "key", F.inline(packed))


def auroc_bootstrap(df: DataFrame, signals: Mapping[str, Column], reps: int, seed: int, key: str = "item_no") -> DataFrame:
    """AUROC of every signal in every replicate under the same draws; one-class replicates come back NULL."""
    own = {f"s{i}": s for i, s in enumerate(signals.values())}
    found = cells(df, {"large": F.col("large"), **own}, key)
    return replicate_auroc(signals_of(found, {n: F.col(f"s{i}") for i, n in enumerate(signals)}), ["signal"], reps, seed)


def queue_difference_bootstrap(df: DataFrame, old: Column, new: Column, reps: int, seed: int, fold: str = "cv_fold", key: str = "item_no") -> DataFrame:
    """Two queues against each other and against chance, per scope (each fold, and all folds pooled) and replicate.

    Expects flags ``large``, ``old``, ``new`` (in the queue of its fold) and ``rate``, the fold's inclusion probability;
    ``old`` and ``new`` as columns are the two scores.
    """
    columns = {"fold": F.col(fold), "large": F.col("large"), "in_old": F.col("old"), "in_new": F.col("new"), "rate": F.col("rate"), "s_old": old, "s_new": new}
    found = cells(df, columns, key)
    scopes = F.explode(F.array(F.concat(F.lit("fold"), F.col("fold").cast("string")), F.lit("pooled"))).alias("scope")
    flag = lambda *names: F.lit(1.0) * sum((F.col(n).cast("int") for n in names[1:]), F.col(names[0]).cast("int")).eqNullSafe(len(names)).cast("double")
    sums = replicate_sums(found, ["fold"], {
        "caught_old": flag("large", "in_old"), "caught_new": flag("large", "in_new"), "positives": flag("large"), "expected": flag("large") * F.col("rate"),
    }, reps, seed)
    linear = sums.select(scopes, "rep", "caught_old", "caught_new", "positives", "expected").groupBy("scope", "rep").agg(
        *[F.sum(c).alias(c) for c in ("caught_old", "caught_new", "positives", "expected")]
    )
    area = replicate_auroc(signals_of(found, {"old": F.col("s_old"), "new": F.col("s_new")}, [scopes]), ["scope", "signal"], reps, seed)
    at = lambda s: F.max(F.when(F.col("signal") == s, F.col("auroc")))
    area = area.groupBy("scope", "rep").agg(at("old").alias("auroc_old"), at("new").alias("auroc_new"))
    delta = F.col("caught_new") - F.col("caught_old")
    return linear.join(area, ["scope", "rep"]).select(
        "scope", "rep", delta.alias("delta_caught"), F.try_divide(delta, F.col("positives")).alias("delta_capture"),
        *[F.round(F.col(f"caught_{q}") - F.col("expected"), 9).alias(f"{q}_excess") for q in ("new", "old")],  # no sign from rounding
        "auroc_old", "auroc_new", (F.col("auroc_new") - F.col("auroc_old")).alias("delta_auroc"),
    )


def cluster_bootstrap(
    df: DataFrame, cluster: str, sums: Mapping[str, Column], reps: int, seed: int | str
) -> DataFrame:
    """Resample clusters with replacement; statistics are linear in the clusters' sums.

    Items are read once to form the sums; the replicates touch clusters only.
    """
    per = df.groupBy(cluster).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    indexed = rank_rows(per, [cluster], rank="idx", size="clusters")
    slots = indexed.select("idx", "clusters", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    pick = F.floor(uniform(seed, "rep", "idx") * F.col("clusters")) + 1
    weights = slots.groupBy("rep", pick.alias("idx")).agg(F.count(F.lit(1)).alias("w"))
    drawn = weights.join(indexed.select("idx", *sums), "idx")
    return drawn.groupBy("rep").agg(*[F.sum(F.col("w") * F.col(k)).alias(k) for k in sums])


def estimates(draws: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The sample's value with mean, percentile interval and counts of its valid and skipped replicates."""
    x = F.when((F.col("rep") > 0) & ~F.isnan(value), F.col(value))
    q = F.percentile(x, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*by).agg(
        F.max(F.when((F.col("rep") == 0) & ~F.isnan(value), F.col(value))).alias("estimate"), F.avg(x).alias("mean"), q[0].alias("low"), q[1].alias("high"),
        F.count(x).alias("valid"), (F.count_if(F.col("rep") > 0) - F.count(x)).alias("skipped"),
    )


def sign_shares(draws: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``estimates``, width and the shares of positive, zero and negative replicates per statistic."""
    rows = draws.select("rep", *by, F.inline(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("v")) for v in values])))
    drawn = rows.where("rep > 0").groupBy(*by, "metric").agg(
        F.count_if(F.col("v") > 0).alias("positive"), F.count_if(F.col("v") == 0).alias("zero"), F.count_if(F.col("v") < 0).alias("negative"),
        F.avg((F.col("v") > 0).cast("double")).alias("share_positive"),
    )
    return estimates(rows, "v", [*by, "metric"]).withColumn("width", F.col("high") - F.col("low")).join(drawn, [*by, "metric"])


# ---- statistics of ranks ----------------------------------------------------------------------------------------------


def _ranks(codes: np.ndarray, size: int, w: np.ndarray) -> np.ndarray:
    """Centred average ranks under multiplicities."""
    each = np.bincount(codes, w, size)
    return (np.cumsum(each) - each / 2 - each.sum() / 2)[codes]


def _correlation(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    n = w.sum()
    if not n:
        return float("nan")
    a, b = a - (w @ a) / n, b - (w @ b) / n
    va, vb = w @ (a * a), w @ (b * b)
    return float(w @ (a * b) / np.sqrt(va * vb)) if va > 1e-12 and vb > 1e-12 else float("nan")


def _median(values: np.ndarray, w: np.ndarray) -> float:
    """Median of the values repeated ``w`` times; the values rise."""
    total = np.cumsum(w)
    n = total[-1] if len(total) else 0
    if not n:
        return float("nan")
    at = np.searchsorted(total, [(n - 1) // 2, n // 2], "right")
    return float(values[at].mean())


def replicate_statistics(
    cells: DataFrame, columns: Sequence[str], names: Sequence[str], prepare: Callable[[list[np.ndarray]], Callable[[np.ndarray], list[float]]], reps: int, seed: int,
) -> DataFrame:
    """(rep, names...) of a statistic of all cells; each task holds the cells and a block of replicates.

    Only for cells whose number was checked.  ``prepare`` gets the columns once per task and returns the statistic of
    a weight vector.
    """
    spark = cells.sparkSession
    got = cells.orderBy("key").select(*[F.col(c).cast("double").alias(c) for c in columns], "m", "key").toPandas()
    shared = spark.sparkContext.broadcast([got[c].to_numpy() for c in (*columns, "m", "key")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        *values, m, key = shared.value
        statistic = prepare(values)
        step = max(1, BLOCK // max(1, len(m)))
        for pdf in batches:
            rep = pdf["rep"].to_numpy()
            rows = []
            for i in range(0, len(rep), step):
                w = poisson_weights(key, m, rep[i : i + step], seed)
                rows += [statistic(np.ascontiguousarray(w[:, j])) for j in range(w.shape[1])]
            yield pd.DataFrame(rows, columns=list(names)).assign(rep=rep)[["rep", *names]]

    blocks = spark.range(0, reps + 1, 1, 4 * spark.sparkContext.defaultParallelism).select(F.col("id").cast("int").alias("rep"))
    return blocks.mapInPandas(run, "rep int, " + ", ".join(f"{n} double" for n in names))


def _few_values(cells: DataFrame, columns: Sequence[str], limit: int) -> list[np.ndarray] | None:
    """Distinct values of the columns, rising, a missing one last; none if they are more than ``limit`` in all."""
    packed = F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(F.col(c), F.lit(float("nan"))).alias("v")) for i, c in enumerate(columns)])
    found = cells.select(F.inline(packed)).distinct().limit(limit + 1).toPandas()
    if len(found) > limit:
        return None
    return [np.sort(found.loc[found["i"] == i, "v"].to_numpy()) for i in range(len(columns))]


def _spearman_by_values(cells: DataFrame, columns: Sequence[str], values: list[np.ndarray], spots: Sequence[tuple[int, int]], reps: int, seed: int) -> DataFrame:
    """(rep, r0...) of pairs of columns of few values, however many the cells: weights of the values meet and are ranked,
    then every task draws its cells again and adds up the products of their ranks."""
    spark, small = cells.sparkSession, BLOCK >> 3
    dealt = spread(cells, "key").sortWithinPartitions("m")
    starts = range(0, reps + 1, RANKED)

    def coded(part: pd.DataFrame) -> list[np.ndarray]:
        return [np.searchsorted(v, part[c].to_numpy(dtype=float)) for c, v in zip(columns, values)]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros((len(v), reps + 1)) for v in values]
        for pdf in batches:
            for part, w in _weighted(pdf, reps, seed, small):
                for out, code in zip(total, coded(part)):
                    for j, k in enumerate(code.tolist()):  # whole rows of replicates
                        out[k] += w[j]
        for i, out in enumerate(total):
            for start in starts:
                yield pd.DataFrame({"i": [i], "start": [start], "sums": [out[:, start : start + RANKED].tobytes()]})

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        i, start = int(pdf["i"].iloc[0]), int(pdf["start"].iloc[0])
        n = sum(np.frombuffer(b) for b in pdf["sums"]).reshape(len(values[i]), -1)
        ranks = np.cumsum(n, 0) - n / 2 - n.sum(0) / 2
        return pd.DataFrame({"i": [i], "start": [start], "ranks": [ranks.tobytes()], "squares": [(n * ranks * ranks).sum(0).tolist()]})

    sums = dealt.mapInPandas(add, "i int, start int, sums binary")
    got = materialise(sums.groupBy("i", "start").applyInPandas(rank, "i int, start int, ranks binary, squares array<double>"), "ranks").orderBy("i", "start").toPandas()
    sides = [got[got["i"] == i] for i in range(len(columns))]
    shared = spark.sparkContext.broadcast([np.hstack([np.frombuffer(b).reshape(len(v), -1) for b in side["ranks"]]) for v, side in zip(values, sides)] if len(got) else [])
    names = [f"p{i}" for i in range(len(spots))]

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(spots), reps + 1))
        for pdf in batches:
            for part, w in _weighted(pdf, reps, seed, small):
                held = [ranks[code] for ranks, code in zip(shared.value, coded(part))]
                for out, (a, b) in zip(total, spots):
                    out += np.einsum("ij,ij,ij->j", w, held[a], held[b])
        yield pd.DataFrame(total.T, columns=names).assign(rep=np.arange(reps + 1, dtype=np.int32))[["rep", *names]]

    products = dealt.mapInPandas(multiply, "rep int, " + ", ".join(f"{n} double" for n in names)).groupBy("rep").agg(*[F.sum(n).alias(n) for n in names])
    squares = pd.DataFrame({f"q{i}": np.concatenate([np.asarray(s) for s in side["squares"]]) if len(side) else [] for i, side in enumerate(sides)})
    known = spark.createDataFrame(squares.assign(rep=np.arange(len(squares), dtype=np.int32)), "".join(f"q{i} double, " for i in range(len(columns))) + "rep int")
    q = lambda i: F.col(f"q{i}")
    rho = [F.when((q(a) > 1e-12) & (q(b) > 1e-12), F.col(n) / F.sqrt(q(a) * q(b))).alias(f"r{k}") for k, (n, (a, b)) in enumerate(zip(names, spots))]
    return products.join(F.broadcast(known), "rep").select("rep", *rho)  # one row per replicate


def spearman_bootstrap(
    df: DataFrame, pairs: Mapping[str, tuple[Column, Column]], reps: int, seed: int, key: str = "item_no", limit: int = CELLS, ranks: int = RANKS
) -> DataFrame:
    """(pair, rep, spearman) of several pairs under the same draws; undefined replicates are NULL."""
    sides = {str(s): s for p in pairs.values() for s in p}
    number = {s: f"v{i}" for i, s in enumerate(sides)}
    found = cells(df, {number[s]: c.cast("double") for s, c in sides.items()}, key)
    places = [(number[str(a)], number[str(b)]) for a, b in pairs.values()]
    columns = list(number.values())
    spots = [(columns.index(a), columns.index(b)) for a, b in places]
    few, values = found.count() <= limit, None
    if not few:
        values = _few_values(found, columns, ranks // (reps + 1))
    if few:

        def prepare(values):
            codes = [np.unique(v, return_inverse=True) for v in values]

            def statistic(w):
                ranks = [_ranks(c, len(u), w) for u, c in codes]
                return [_correlation(ranks[a], ranks[b], w) for a, b in spots]

            return statistic

        wide = replicate_statistics(found, columns, [f"r{i}" for i in range(len(pairs))], prepare, reps, seed)
    elif values:
        wide = _spearman_by_values(found, columns, values, spots, reps, seed)
    if few or values:
        packed = F.array(*[F.struct(F.lit(n).alias("pair"), F.col(f"r{i}").alias("spearman")) for i, n in enumerate(pairs)])
        out = wide.select("rep", F.inline(packed)).select("pair", "rep", "spearman")
    else:
        packed = F.array(*[F.struct(F.lit(n).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for n, (a, b) in zip(pairs, places)])
        rows = replicate(found, reps, seed).select("rep", "w", F.inline(packed))
        rows = materialise(rows.groupBy("pair", "rep", "x", "y").agg(F.sum("w").alias("w")), "replicates")
        out = spearman(rows, "x", "y", ["pair", "rep"], "w").select("pair", "rep", "spearman")
    return out.withColumn("spearman", F.nanvl("spearman", F.lit(None).cast("double")))


AGREEMENT = ("mean_a", "mean_b", "absolute_mean_gap", "mean_ratio", "pearson", "spearman", "median_a", "median_b")


def agreement_bootstrap(df: DataFrame, a: str, b: str, reps: int, seed: int, key: str = "item_no", limit: int = CELLS) -> DataFrame:
    """Per replicate: means and medians of two counts, both correlations, the absolute gap and the ratio of the means."""
    found = cells(df, {"a": F.col(a).cast("double"), "b": F.col(b).cast("double")}, key)
    if found.count() <= limit:

        def prepare(values):
            (ua, ca), (ub, cb) = (np.unique(v, return_inverse=True) for v in values)
            x, y = values

            def statistic(w):
                n = w.sum()
                if not n:
                    return [float("nan")] * len(AGREEMENT)
                ma, mb = float(w @ x) / n, float(w @ y) / n
                each = np.bincount(ca, w, len(ua)), np.bincount(cb, w, len(ub))
                rho = _correlation(_ranks(ca, len(ua), w), _ranks(cb, len(ub), w), w)
                return [ma, mb, abs(mb - ma), mb / ma if ma else float("nan"), _correlation(x, y, w), rho, _median(ua, each[0]), _median(ub, each[1])]

            return statistic

        out = replicate_statistics(found, ["a", "b"], AGREEMENT, prepare, reps, seed)
        return out.select("rep", *[F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in AGREEMENT])
    rows = materialise(replicate(found, reps, seed), "replicates")
    w = F.col("w")
    mean = lambda x: F.sum(w * F.col(x)) / F.sum("w")
    basic = rows.groupBy("rep").agg(
        mean("a").alias("mean_a"), mean("b").alias("mean_b"), F.abs(mean("b") - mean("a")).alias("absolute_mean_gap"),
        F.try_divide(mean("b"), mean("a")).alias("mean_ratio"), pearson(F.col("a"), F.col("b"), w).alias("pearson"),
    )
    rho = spearman(rows, "a", "b", ["rep"], "w").select("rep", "spearman")
    ma = quantiles(rows, "a", {"median_a": 0.5}, ["rep"], weight="w")
    mb = quantiles(rows, "b", {"median_b": 0.5}, ["rep"], weight="w")
    return basic.join(rho, "rep").join(ma, "rep").join(mb, "rep").select("rep", *AGREEMENT)


def slope_bootstrap(df: DataFrame, y: Column, x: Column, reps: int, seed: int, key: str = "item_no") -> DataFrame:
    """Least-squares slope per replicate from weighted moments; rank-deficient replicates are NULL."""
    found = cells(df, {"y": y, "x": x}, key)
    x, y = F.col("x"), F.col("y")
    s = replicate_sums(found, [], {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y}, reps, seed)
    var = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    return s.select("rep", F.when(var > 0, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / var).alias("slope"))


def error_correlations(
    df: DataFrame, errors: Mapping[str, Column], reps: int, seed: int, limit: float = 0.95, key: str = "item_no"
) -> DataFrame:
    """Pearson and Spearman correlation of the models' signed errors with intervals.

    Flags tell whether the estimate, and whether the whole interval, lies below the limit.
    """
    from itertools import combinations

    names, pairs = list(errors), list(combinations(errors, 2))
    base = df.select(key, *[v.cast("double").alias(n) for n, v in errors.items()])
    moments = {"n": F.lit(1.0)} | {f"s_{a}": F.col(a) for a in names} | {f"q_{a}": F.col(a) * F.col(a) for a in names}
    moments |= {f"p_{i}": F.col(a) * F.col(b) for i, (a, b) in enumerate(pairs)}
    sums = replicate_sums(cells(base, {n: F.col(n) for n in names}, key), [], moments, reps, seed)
    n, s = F.col("n"), lambda a: F.col(f"s_{a}")
    var = lambda a: F.col(f"q_{a}") - s(a) * s(a) / n
    linear = [
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.when((var(a) > 0) & (var(b) > 0), (F.col(f"p_{i}") - s(a) * s(b) / n) / F.sqrt(var(a) * var(b))).alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    pearson_draws = sums.select("rep", F.inline(F.array(*linear))).withColumn("method", F.lit("pearson"))
    ranked = spearman_bootstrap(base, {f"{a}|{b}": (F.col(a), F.col(b)) for a, b in pairs}, reps, seed, key)
    part = F.split("pair", r"\|")
    ranked = ranked.select("rep", part[0].alias("model_a"), part[1].alias("model_b"), F.col("spearman").alias("r"), F.lit("spearman").alias("method"))
    out = estimates(pearson_draws.unionByName(ranked), "r", ["model_a", "model_b", "method"])
    return out.withColumns({"below_limit": F.col("estimate") < limit, "interval_below_limit": F.col("high") < limit})
