"""Conversations as training windows of a chat template, in DataFrame functions only.

Prefix sums of the turns' tokens cut a conversation into turn-aligned spans.  A window is the system turn, if the
conversation begins with one, then the last turns before the span as far as ``history`` tokens go, then the span.  The
loss mask covers the assistant texts of the span only, so over all windows each lies under it once.

Turns read ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside texts and roles, ``<`` followed by any number of ``&`` and
``|`` gets one more ``&``, which no other string turns into; a line end in a role is written ``<|n|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklens.llm.quality import words_of

#: Tokens of a span, which the turn at its end may exceed; tokens of the repeated history; tokens of a turn's marks.
SPAN, HISTORY, MARKS = 512, 128, 4
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(&*)\|", "<&$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<&(&*)\|", "<$1|")


def windows(conversations: DataFrame, span: int = SPAN, history: int = HISTORY) -> DataFrame:
    """One row per window: ``conv_id, window, text, repeated, loss``.

    ``repeated`` counts the leading turns that stand in earlier windows too; ``loss`` has the (start, end) code points
    under the loss mask.  ``conversations`` has ``conv_id, turn, role, text``; turns go by ``turn``, then role and text,
    null turns first; null roles and texts are empty ones; repeated rows are turns like others; rows of a null id are
    one conversation; other columns are ignored; no rows give no windows.  A turn is never cut: a longer one than
    ``span`` makes its span longer.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("place", F.row_number().over(ordered))
    turns = turns.withColumn("system", (F.col("place") == 1) & (F.col("role") == "system"))
    turns = turns.withColumn("tokens", F.when(F.col("system"), 0).otherwise(F.size(words_of(F.col("text"))) + MARKS).cast("long"))
    turns = turns.withColumn("at", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    turns = turns.withColumn("window", F.floor(F.col("at") / span))
    head = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("<|n|>")), F.lit("\n"))
    turns = turns.select(
        "conv_id", "window", "place", "at", "system", head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("target"),
    )
    # A span's place among the prefix sums, and which spans a turn can be history of.
    spans = turns.groupBy("conv_id", "window").agg(F.min(F.when(~F.col("system"), F.col("at"))).alias("start"))
    last = F.floor((F.col("at") + history) / span)
    later = turns.where(~F.col("system") & (last > F.col("window"))).withColumn("window", F.explode(F.sequence(F.col("window") + 1, last)))
    x, y = later.alias("x"), spans.alias("y")
    past = x.join(y, _same(x, y) & (F.col("x.window") == F.col("y.window")) & (F.col("y.start") - F.col("x.at") <= history)).select("x.*")
    x, y = turns.where("system").alias("x"), spans.where("window > 0").alias("y")
    system = x.join(y, _same(x, y)).select("x.conv_id", "y.window", "x.place", "x.at", "x.system", "x.head", "x.body", "x.target")
    rows = turns.withColumn("again", F.lit(False)).union(past.withColumn("again", F.lit(True))).union(system.withColumn("again", F.lit(True)))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    inside = Window.partitionBy("conv_id", "window").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum(F.char_length("piece")).over(inside), F.lit(0)) + F.char_length("head"))
    mask = F.when(F.col("target") & ~F.col("again"), F.struct(F.col("offset").alias("start"), (F.col("offset") + F.char_length("body")).alias("end")))
    made = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("p"), F.count_if("again").alias("repeated"), F.sort_array(F.collect_list(mask)).alias("loss")
    )
    return made.select("conv_id", "window", F.array_join(F.col("p")["piece"], "").alias("text"), "repeated", "loss")


def _same(x: DataFrame, y: DataFrame) -> Column:
    return F.col("x.conv_id").eqNullSafe(F.col("y.conv_id"))


def read_back(made: DataFrame) -> DataFrame:
    """One row per window: its new turns as (role, text) and the texts under its loss mask, unescaped."""
    marked = F.slice(F.split("text", r"<\|im_start\|>"), (F.col("repeated") + 2).cast("int"), F.lit(1 << 30))
    form = r"(?s)^([^\n]*)\n(.*)<\|im_end\|>\n$"
    role = lambda p: unescaped(F.replace(F.regexp_extract(p, form, 1), F.lit("<|n|>"), F.lit("\n")))
    turns = F.transform(marked, lambda p: F.struct(role(p).alias("role"), unescaped(F.regexp_extract(p, form, 2)).alias("text")))
    loss = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return made.select("conv_id", "window", turns.alias("turns"), loss.alias("targets"), F.char_length("text").alias("chars"))
