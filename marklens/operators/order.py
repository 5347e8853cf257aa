"""Order-dependent operators that never put an unbounded group in one task.

A window without partition keys, or one over a hot key, would send all its rows to a single task.
Here a global range sort spreads the rows over segments of similar size, even inside one hot group
or one tied value, and a table with one row per (group, segment) carries the offsets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklens.session import materialise

_LOW_BITS = (1 << 33) - 1


def _name(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on equally named keys; keeps the left copy of each key."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


#: A value that holds more than this part of the rows is looked up apart, so at most so many values are.
HEAVY = 1000


def value_join(df: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of rows to a table with one row per value, null-safe, where few values may hold most of the rows.

    ``count`` of the table tells how many rows have the value.  Values with more than the ``HEAVY``-th part of all rows
    are fewer than ``HEAVY``, so their part of the table is sent to every task and their rows stay where they are; the
    other rows are shuffled by value, none of which can fill a task.  ``df`` is read twice and should be a written table.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * HEAVY > total
    extra = [c for c in table.columns if c not in keys and c != count]
    hot = table.where(heavy).select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.struct(*extra).alias("_hot"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    marked = df.join(F.broadcast(hot), same, "left").drop(*[f"_r_{k}" for k in keys])
    near = marked.where(F.col("_hot").isNotNull()).select(*df.columns, *[F.col(f"_hot.{c}").alias(c) for c in extra])
    far = _join_on(marked.where(F.col("_hot").isNull()).drop("_hot"), table.where(~heavy).drop(count), keys)
    return near.unionByName(far)


#: Offsets (groups x segments) known to be few enough to be sent to every task.
OFFSET_ROWS = 1_000_000


def _attach(table: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """Join the offsets of the segments to their rows.

    The offsets are a written table of one row per group and segment.  While they are few, the ordered rows stay where
    they are; beyond that both sides are shuffled by segment and group.
    """
    per = materialise(per, "offsets")
    few = per.limit(OFFSET_ROWS + 1).count() <= OFFSET_ROWS
    right = per.select(*[F.col(k).alias(f"_r_{k}") if k in [*keys, "_seg"] else F.col(k) for k in per.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.col("_seg") == F.col("_r__seg"))
    return table.join(F.broadcast(right) if few else right, cond).drop("_r__seg", *[f"_r_{k}" for k in keys])


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, as a scalar subquery rather than a join."""
    packed = df.withColumn("_row", row.select(F.struct("*")).scalar())
    return packed.select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in row.columns])


def ordered_table(df: DataFrame, keys: list, segments: int | None = None) -> DataFrame:
    """Globally sort by ``keys`` and write; ``_seg``/``_pos`` give each row's place."""
    cols = [_name(k) for k in keys]
    if segments:
        out = df.repartitionByRange(segments, *cols).sortWithinPartitions(*cols)
    else:
        out = df.orderBy(*cols)
    out = out.withColumn("_mid", F.monotonically_increasing_id())
    out = out.withColumn("_seg", F.shiftright("_mid", 33).cast("int")).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))
    )
    return materialise(out.drop("_mid"), "ordered")


def rank_rows(
    df: DataFrame,
    order: list,
    partition: list[str] | None = None,
    rank: str = "rank",
    size: str | None = "group_n",
    segments: int | None = None,
) -> DataFrame:
    """Exact ``row_number`` per group plus the group size, whatever the group sizes are.

    ``order`` must end in a unique key, so that ties are broken the same way on every run.
    """
    groups = list(partition or [])
    table = ordered_table(df, [*groups, *order], segments)
    if not groups:
        table = table.withColumn("_all", F.lit(0))
    keys = groups or ["_all"]
    per = table.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        *keys,
        "_seg",
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    out = _attach(table, per, keys)
    out = out.withColumn(rank, F.col("_before") + F.col("_pos") - F.col("_first") + 1)
    if size:
        out = out.withColumn(size, F.col("_total"))
    return out.drop("_seg", "_pos", "_first", "_before", "_total", "_all")


def running_sums(
    df: DataFrame, key: str, sums: list[str], partition: list[str] | None = None, segments: int | None = None
) -> DataFrame:
    """``cum_x`` (inclusive) and ``total_x`` for each ``x`` in ``sums`` over the order of ``key``.

    Rows are expected at the grain (group, key), i.e. aggregated before, so that a value shared by
    a third of all items is one row here.
    """
    groups = list(partition or [])
    table = ordered_table(df, [*groups, key], segments)
    if not groups:
        table = table.withColumn("_all", F.lit(0))
    keys = groups or ["_all"]
    per = table.groupBy(*keys, "_seg").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    per = per.select(
        *keys,
        "_seg",
        *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums],
        *[F.sum(f"_s_{s}").over(whole).alias(f"total_{s}") for s in sums],
    )
    local = Window.partitionBy(*keys, "_seg").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumns({f"_c_{s}": F.sum(s).over(local) for s in sums})
    out = _attach(table, per, keys)
    out = out.withColumns({f"cum_{s}": F.col(f"_b_{s}") + F.col(f"_c_{s}") for s in sums})
    return out.drop("_seg", "_pos", "_all", *[f"_b_{s}" for s in sums], *[f"_c_{s}" for s in sums])


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    partition: list[str] | None = None,
    segments: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group; ``probs`` maps output name to probability.

    Spark's ``percentile`` keeps every distinct value of a group in one buffer.  This keeps one row
    per distinct value spread over the cluster and picks the two order statistics around each
    position by their cumulative counts.  A ``weight`` counts a row that many times.
    """
    groups = list(partition or [])
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(n.alias("n"))
    run = running_sums(counts, value, ["n"], groups, segments)
    return quantiles_of_counts(run, value, "n", probs, groups)


def quantiles_of_counts(
    run: DataFrame, value: str, count: str, probs: dict[str, float], partition: list[str]
) -> DataFrame:
    """Quantiles from a ``running_sums`` table of value counts."""
    n, cum, total = F.col(count), F.col(f"cum_{count}"), F.col(f"total_{count}")
    aggs, outs = [], []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (total - 1)
        holds = lambda i: (cum - n <= i) & (i < cum)
        aggs += [
            F.max(F.when(holds(F.floor(pos)), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(holds(F.ceil(pos)), F.col(value))).alias(f"_hi_{name}"),
            F.max(pos - F.floor(pos)).alias(f"_w_{name}"),
        ]
        lo = F.col(f"_lo_{name}").cast("double")
        outs.append((lo + (F.col(f"_hi_{name}") - lo) * F.col(f"_w_{name}")).alias(name))
    return run.groupBy(*partition).agg(*aggs).select(*partition, *outs)


def average_ranks(
    df: DataFrame, value: str, partition: list[str] | None = None, weight: str | None = None,
    rank: str = "avg_rank", segments: int | None = None,
) -> DataFrame:
    """Average rank of each distinct value; with ``weight``, ranks under row multiplicities."""
    groups = list(partition or [])
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*groups, value).agg(n.alias("n"), F.count(F.lit(1)).alias("rows"))
    run = running_sums(counts, value, ["n"], groups, segments)
    return run.select(
        *groups, value, "n", "rows", "total_n", (F.col("cum_n") - F.col("n") / 2 + F.lit(0.5)).alias(rank)
    )


def spearman(
    df: DataFrame, x: str, y: str, partition: list[str] | None = None, weight: str | None = None,
    segments: int | None = None,
) -> DataFrame:
    """Spearman correlation per group: Pearson on centred average ranks at distinct-pair grain."""
    groups = list(partition or [])
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.sum(weight) if weight else F.count(F.lit(1))
    # written once: both rank tables and the join read the pairs, not the items
    pairs = materialise(df.groupBy(*groups, x, y).agg(n.alias("_w")), "pairs")
    rx = materialise(average_ranks(pairs, x, groups, "_w", "_rx", segments).select(*groups, x, "_rx", "total_n", "rows"), "ranks")
    ry = materialise(average_ranks(pairs, y, groups, "_w", "_ry", segments).select(*groups, y, "_ry", "rows"), "ranks")
    first = materialise(value_join(pairs, rx, [*groups, x], "rows"), "ranked")
    ranked = value_join(first, ry, [*groups, y], "rows")
    mid = (F.col("total_n") + 1) / 2
    a, b, w = F.col("_rx") - mid, F.col("_ry") - mid, F.col("_w")
    out = ranked.groupBy(*groups).agg(
        F.sum("_w").alias("n"),
        F.sum(w * a * b).alias("_ab"),
        F.sum(w * a * a).alias("_aa"),
        F.sum(w * b * b).alias("_bb"),
    )
    rho = F.try_divide(F.col("_ab"), F.sqrt(F.col("_aa") * F.col("_bb")))
    return out.select(*groups, "n", rho.alias("spearman"))


def auroc(
    df: DataFrame, score: str, label: str, partition: list[str] | None = None, weight: str | None = None,
    segments: int | None = None,
) -> DataFrame:
    """Area under the ROC curve with half credit for ties; NULL when one class is absent."""
    groups = list(partition or [])
    w = F.col(weight) if weight else F.lit(1)
    counts = df.groupBy(*groups, score).agg(
        F.sum(F.when(F.col(label), w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label), 0).otherwise(w)).alias("neg"),
    )
    run = running_sums(counts, score, ["neg"], groups, segments)
    out = run.groupBy(*groups).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)).alias("u"),
    )
    area = F.try_divide(F.col("u"), F.col("positives").cast("double") * F.col("negatives"))
    return out.select(*groups, "positives", "negatives", area.alias("auroc"))


def ks_statistic(
    df: DataFrame, value: str, in_first: Column, partition: list[str] | None = None, segments: int | None = None
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance between rows with and without ``in_first``."""
    groups = list(partition or [])
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        F.count_if(in_first).alias("a"), F.count_if(~in_first).alias("b")
    )
    run = running_sums(counts, value, ["a", "b"], groups, segments)
    gap = F.abs(F.col("cum_a") / F.col("total_a") - F.col("cum_b") / F.col("total_b"))
    return run.groupBy(*groups).agg(F.max(gap).alias("ks"))


def lookup(df: DataFrame, table: DataFrame, key: str, salt_by: str | list[str], limit: int = 1_000_000, salts: int = 32) -> DataFrame:
    """Left join to a lookup table on one key.

    The table is broadcast only when a bounded count shows it has at most ``limit`` rows.  Beyond
    that the key is salted: the rows of a hot key go to ``salts`` tasks and the table is repeated.
    """
    if table.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(table), key, "left")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*([salt_by] if isinstance(salt_by, str) else salt_by)), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Spark takes the copies for as small as the table's files and would send all of them to every task
    return salted.join(copies.hint("merge"), [key, "_salt"], "left").drop("_salt")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows over all cores before each of them is multiplied by replicates or draws."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, key)


def widen(scan: DataFrame) -> DataFrame:
    """Give a scan of few splits as many tasks as there are cores; a scan with enough splits stays as it is."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(n) if scan.rdd.getNumPartitions() < n else scan


def seeded_key(seed: str | int, *parts: str | Column) -> Column:
    """``md5(seed:part:...)``: the seeded order that Spark and any SQL engine agree on."""
    pieces = [F.lit(str(seed)), *[_name(p).cast("string") for p in parts]]
    return F.md5(F.concat_ws(":", *pieces).cast("binary"))


def rank_by_key(
    df: DataFrame, key: str, unique: str, partition: list[str] | None = None,
    rank: str = "rank", size: str = "group_n", digits: int = 3,
) -> DataFrame:
    """Exact rank by a uniform hex key per group.

    The first ``digits`` hex digits cut every group, however large, into 16**digits buckets of
    about equal size; ranks are local to a bucket plus the count of the buckets before it.
    """
    groups = list(partition or [])
    keyed = df.withColumn("_b", F.substring(key, 1, digits))
    if not groups:
        keyed = keyed.withColumn("_all", F.lit(0))
    keys = groups or ["_all"]
    counts = keyed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *keys, "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(size),
    )
    local = Window.partitionBy(*keys, "_b").orderBy(key, unique)
    out = _join_on(keyed.withColumn("_rn", F.row_number().over(local)), counts, [*keys, "_b"])
    return out.withColumn(rank, F.col("_before") + F.col("_rn")).drop("_b", "_rn", "_before", "_all")


def select_by_key(
    df: DataFrame, key: str, unique: str, size: Column, partition: list[str], digits: int = 3
) -> DataFrame:
    """Rows with the ``size`` smallest keys per group; ``size`` may use ``group_n``.

    Only per-bucket counts and the rows of one boundary bucket per group are shuffled.
    """
    keyed = df.withColumn("_b", F.substring(key, 1, digits))
    counts = keyed.groupBy(*partition, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*partition).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_cum", F.sum("_n").over(upto)).withColumn(
        "group_n", F.sum("_n").over(Window.partitionBy(*partition))
    ).withColumn("_k", size)
    # the bucket that holds the k-th row; with k = 0 no bucket does and nothing is selected
    edge = counts.where((F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_n") < F.col("_k"))).select(
        *partition, F.col("_b").alias("_edge"), (F.col("_k") - F.col("_cum") + F.col("_n")).alias("_rest"),
        "group_n", F.col("_k").alias("queue_size"),
    )
    joined = _join_on(keyed, edge, partition)
    sure = joined.where(F.col("_b") < F.col("_edge"))
    local = Window.partitionBy(*partition).orderBy(key, unique)
    border = joined.where(F.col("_b") == F.col("_edge")).withColumn("_rn", F.row_number().over(local))
    border = border.where(F.col("_rn") <= F.col("_rest")).drop("_rn")
    return sure.unionByName(border).drop("_b", "_edge", "_rest")


def budget_size(n: str | Column, budget: float | Column) -> Column:
    """``ceil(n * budget)`` in double arithmetic."""
    share = budget if isinstance(budget, Column) else F.lit(float(budget))
    return F.ceil(_name(n).cast("double") * share)


def queue(
    df: DataFrame, order: list, budget: float, partition: list[str] | None = None, segments: int | None = None
) -> DataFrame:
    """Rank by ``order`` inside each group and flag the first ``ceil(budget * n)`` rows."""
    if not 0 <= budget <= 1:
        raise ValueError("budget must lie in [0, 1]")
    out = rank_rows(df, order, partition, "rank", "group_n", segments)
    return out.withColumn("queue_size", budget_size("group_n", budget)).withColumn(
        "selected", F.col("rank") <= F.col("queue_size")
    )
