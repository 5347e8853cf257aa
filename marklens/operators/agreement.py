"""Agreement of raters, readers and tools."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklens.functions.metrics import agreement_columns, pearson
from marklens.operators.order import _join_on, quantiles, spearman, with_row


def pair_agreement(df: DataFrame, by: Sequence[str], a: str = "r1", b: str = "r2") -> DataFrame:
    cols = agreement_columns(F.col(a), F.col(b))
    return df.groupBy(*by).agg(*[v.alias(k) for k, v in cols.items()])


def model_and_raters(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Model against the aggregate and the single raters, next to the raters against each other."""
    p, h, a, b = (F.col(x) for x in ("prediction", "human", "r1", "r2"))
    cols = agreement_columns(a, b)
    return df.groupBy(*by).agg(
        *[v.alias(k) for k, v in cols.items()],
        F.avg(F.abs(p - h)).alias("model_aggregate_mae"),
        ((F.avg(F.abs(p - a)) + F.avg(F.abs(p - b))) / 2).alias("model_individual_mae"),
        F.avg((F.abs(h - (a + b) / 2) <= 1e-12).cast("double")).alias("aggregate_is_mean_rate"),
    )


def subgroup_agreement(df: DataFrame, attributes: Sequence[str], minimum: int) -> DataFrame:
    """Pair agreement per value of several attributes by grouping sets; small groups are left out."""
    cols = agreement_columns(F.col("r1"), F.col("r2"))
    sets = [[F.col("target"), F.col(a)] for a in attributes]
    out = df.groupingSets(sets, F.col("target"), *[F.col(a) for a in attributes]).agg(*[v.alias(k) for k, v in cols.items()])
    kind = F.coalesce(*[F.when(F.col(a).isNotNull(), F.lit(a)) for a in attributes])
    out = out.withColumn("group_type", kind).withColumn("group_value", F.coalesce(*[F.col(a).cast("string") for a in attributes]))
    return out.where((F.col("n") >= minimum) & F.col("group_type").isNotNull()).drop(*attributes)


def disagreement_vs_error(df: DataFrame) -> DataFrame:
    """Rater disagreement against model error per target, and its share in the top error decile."""
    rows = df.withColumns({"gap": F.abs(F.col("r1") - F.col("r2")), "err": F.abs(F.col("prediction") - F.col("human"))})
    rho = spearman(rows, "gap", "err", ["target"])
    p90 = quantiles(rows, "err", {"p90": 0.9}, ["target"])
    joined = rows.join(F.broadcast(p90), "target")  # one row per target
    agg = joined.groupBy("target").agg(
        F.avg(F.when(F.col("gap") == 0, F.col("err"))).alias("error_if_agree"),
        F.avg(F.when(F.col("gap") > 0, F.col("err"))).alias("error_if_disagree"),
        F.avg(F.when(F.col("err") >= F.col("p90"), (F.col("gap") > 0).cast("double"))).alias("disagree_rate_in_top_decile"),
    )
    return rho.join(agg, "target")


def tool_agreement(df: DataFrame, reader: str, tools: Sequence[str], group: str) -> DataFrame:
    """Tool counts against a reader per group and pooled: Spearman, bias, MAE."""
    packed = F.array(*[F.struct(F.lit(t).alias("tool"), F.col(t).cast("double").alias("value")) for t in tools])
    rows = df.select(F.col(group).alias("scope"), F.col(reader).cast("double").alias("reader"), F.inline(packed))
    rows = rows.withColumn("scope", F.explode(F.array("scope", F.lit("pooled"))))
    basic = rows.groupBy("scope", "tool").agg(
        F.avg("value").alias("tool_mean"), F.avg("reader").alias("reader_mean"),
        (F.avg("value") - F.avg("reader")).alias("signed_bias"), F.abs(F.avg("value") - F.avg("reader")).alias("absolute_bias"),
        F.avg(F.abs(F.col("value") - F.col("reader"))).alias("mae"),
    )
    return spearman(rows, "value", "reader", ["scope", "tool"]).join(basic, ["scope", "tool"])


def tool_verdict(table: DataFrame, new: str, old: str, scope: str = "pooled") -> DataFrame:
    """Accepted only with a higher Spearman and a smaller absolute mean gap."""
    at = lambda t, x: F.max(F.when(F.col("tool") == t, F.col(x)))
    out = table.where(F.col("scope") == scope).agg(
        (at(new, "spearman") > at(old, "spearman")).alias("higher_spearman"),
        (at(new, "absolute_bias") < at(old, "absolute_bias")).alias("smaller_gap"),
    )
    return out.withColumn("accepted", F.col("higher_spearman") & F.col("smaller_gap"))


def reader_counts(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Two readers' counts: bias, absolute difference, large differences, both correlations."""
    d = F.col(b).cast("double") - F.col(a)
    basic = df.groupBy(*by).agg(
        F.sum(F.abs(d)).alias("sum_absolute"), F.avg(F.abs(d)).alias("mean_absolute"), F.avg(d).alias("bias"),
        F.count_if(F.abs(d) >= 2).alias("two_or_more"),
        pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias("pearson"),
    )
    return _join_on(spearman(df, a, b, list(by)), basic, list(by))


def reader_summary(df: DataFrame, by: Sequence[str], low: float = 0.5) -> DataFrame:
    """Reader and tool means, medians, low tool counts and Spearman per group.

    Expects ``reader`` and ``tool``.
    """
    by = list(by)
    basic = df.groupBy(*by).agg(
        F.avg("reader").alias("mean_reader"), F.avg("tool").alias("mean_tool"),
        F.avg(F.col("reader") - F.col("tool")).alias("mean_gap"), F.count_if(F.col("tool") < low).alias("tool_below"),
    )
    med = quantiles(df, "reader", {"median_reader": 0.5}, by)
    return _join_on(_join_on(spearman(df, "reader", "tool", by), basic, by), med, by)


def cause_counts(df: DataFrame, readers: Sequence[str], causes: Sequence[int]) -> DataFrame:
    """Count of every cause per reader, zeros kept, with the reader's completeness."""
    packed = F.array(*[F.struct(F.lit(x).alias("reader"), F.col(x).alias("cause")) for x in readers])
    rows = df.select(F.inline(packed))
    state = rows.groupBy("reader").agg(F.count(F.lit(1)).alias("expected"), F.count("cause").alias("given"))
    state = state.select(
        "reader", F.when(F.col("given") == 0, "not_started").when(F.col("given") < F.col("expected"), "incomplete").otherwise("complete").alias("state")
    )
    counts = rows.groupBy("reader", "cause").agg(F.count(F.lit(1)).alias("n"))
    grid = state.withColumn("cause", F.explode(F.array(*[F.lit(i) for i in causes])))
    return grid.join(counts, ["reader", "cause"], "left").na.fill(0, ["n"])


def cause_agreement(df: DataFrame, a: str, b: str, flagged: int) -> DataFrame:
    """Exact agreement of two readers and the items either of them put in a given cause."""
    same = F.col(a) == F.col(b)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same"), F.avg(same.cast("double")).alias("rate"),
        F.count_if((F.col(a) == flagged) | (F.col(b) == flagged)).alias("flagged_by_either"),
    )


def label_set_relation(a: Column, b: Column) -> Column:
    """same set / partial overlap / different."""
    same = F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    return F.when(same, "same").when(F.arrays_overlap(a, b), "partial").otherwise("different")


def list_edit_counts(lists: DataFrame) -> DataFrame:
    """As ``edit_counts``, from one row per document with its lists of edits and sentences; nothing is shuffled."""
    from marklens.functions.scalars import is_grammar_edit

    grammar = F.filter("edits", lambda e: is_grammar_edit(e["edit_type"]))
    types = F.array_sort(F.array_distinct("edits.edit_type"))
    per_type = F.transform(types, lambda t: F.struct(t.alias("edit_type"), F.size(F.filter("edits", lambda e: e["edit_type"] == t)).cast("bigint").alias("n")))
    sentences, hit = F.size("sentences").cast("bigint"), F.size(F.array_distinct(F.transform(grammar, lambda e: e["sent_id"])))
    return lists.select(
        "doc_id", sentences.alias("sentences"), (1 - hit / sentences).alias("clean_sentence_share"), F.size("edits").cast("bigint").alias("edits_all"),
        F.size(grammar).cast("bigint").alias("edits_grammar"), F.map_from_entries(per_type).alias("per_type"),
    )


def edit_counts(edits: DataFrame, sentences: DataFrame) -> DataFrame:
    """Edits per document: all, grammar only, per type, and the share of sentences free of grammar edits.

    ``edits(doc_id, sent_id, edit_type)``; documents without edits survive through ``sentences``.
    """
    from marklens.functions.scalars import is_grammar_edit

    types = edits.groupBy("doc_id", "edit_type").agg(F.count(F.lit(1)).alias("n"))
    per_type = types.groupBy("doc_id").agg(
        F.sum("n").alias("edits_all"),
        F.sum(F.when(is_grammar_edit(F.col("edit_type")), F.col("n")).otherwise(0)).alias("edits_grammar"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("edit_type", "n")))).alias("per_type"),
    )
    grammar = edits.where(is_grammar_edit(F.col("edit_type")))
    hit = grammar.select("doc_id", "sent_id").distinct().withColumn("_hit", F.lit(True))
    clean = sentences.select("doc_id", "sent_id").join(hit, ["doc_id", "sent_id"], "left").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences"), F.avg(F.col("_hit").isNull().cast("double")).alias("clean_sentence_share")
    )
    out = clean.join(per_type, "doc_id", "left").na.fill(0, ["edits_all", "edits_grammar"])
    empty = F.create_map().cast("map<string,bigint>")
    return out.withColumn("per_type", F.coalesce("per_type", empty))
