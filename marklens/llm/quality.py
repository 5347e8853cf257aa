"""Quality rules with a hashed n-gram log-likelihood ratio between trusted and raw text, in DataFrame functions only.

Words and pairs of neighbouring words are hashed into a fixed number of buckets.  Two smoothed multinomials over
them, one of trusted documents and one of the whole corpus, give each bucket a log ratio; a document's score is the
mean over its features.  Documents below a threshold are rejected.  The threshold is the one that best parts all labelled
good from all labelled bad documents, and wrongly rejecting a good one counts ``CAUTION`` times as much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklens.llm.tables import materialise
from marklens.operators.order import lookup

BUCKETS = 1 << 16
#: Log ratios are kept as whole numbers of 1/SCALE, so that sums don't depend on their order.
SCALE = 1000
CAUTION = 10
#: Threshold where labels don't hold both kinds.
DEFAULT_THRESHOLD = -0.2
#: Blocks of 4,096 ids whose marks are sent to every task as bits; beyond that the ids are looked up.
BLOCKS = 1 << 12
MIN_WORDS, MAX_REPEATED = 50, 50
GRID = 0.01


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D\x20]+"), "")


def features(words: Column, buckets: int) -> Column:
    """Bucket of every word and of every word with its successor (the last one: with none)."""
    fold = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: fold(a, b))
    return F.concat(F.transform(words, lambda w: fold(w)), pairs)


def window_hashes(words: Column) -> Column:
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))


def _ordered(hashes: Column) -> Column:
    """(hash, place) of all windows in order; empty where every window is unlike the others."""
    rows = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), rows).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _repeated_places(rows: Column) -> Column:
    """Places, ascending, of the windows that equal a neighbour in the order of hashes."""
    before = F.concat(F.array(F.lit(None).cast("bigint")), rows["h"])
    after = F.slice(rows["h"], F.lit(2), F.greatest(F.size(rows), F.lit(1)))
    near = F.zip_with(F.zip_with(rows, before, lambda r, b: F.struct(r["h"].alias("h"), r["i"].alias("i"), b.alias("b"))), after, lambda r, a: F.when((r["h"] == r["b"]) | (r["h"] == a), r["i"]))
    return F.array_sort(F.array_compact(near))


def _coverage(positions: Column) -> Column:
    """Size of the union of [p, p + 3) over ascending positions."""
    step = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["to"])).alias("n"), (p + 3).alias("to"))
    return F.aggregate(positions, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda a: a["n"])


def base_rules(docs: DataFrame, words: Column, text: Column) -> dict[str, Column]:
    """Counts of the base rules, apart from repeated words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def with_marks(rows: DataFrame, said: DataFrame, marks: list[str]) -> DataFrame:
    """``rows`` with the columns ``marks``, 0 or 1, of the rows of ``said`` by ``doc_id``; 0 where an id is not in it.

    Whole numbers travel as bits, one row per 4,096 ids in a row, so neither texts are shuffled nor does the driver hold
    a hash table of all labels.  Other ids, and those that lie too far apart, are looked up.
    """
    if dict(rows.dtypes)["doc_id"] in _WHOLE and dict(said.dtypes)["doc_id"] in _WHOLE:
        one = F.expr("shiftleft(1L, CAST(doc_id & 63 AS INT))")
        block, word = F.expr("shiftright(CAST(doc_id AS BIGINT), 12)"), F.expr("CAST(shiftright(CAST(doc_id AS BIGINT), 6) & 63 AS INT)")
        words = said.groupBy(block.alias("_block"), word.alias("_word")).agg(*[F.bit_or(F.when(F.col(m) == 1, one).otherwise(F.lit(0).cast("bigint"))).alias(m) for m in marks])
        blocks = words.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", F.struct(*marks)))).alias("_words"))
        blocks = materialise(blocks, "marks")
        if blocks.limit(BLOCKS + 1).count() <= BLOCKS:
            found = rows.withColumn("_block", block).join(F.broadcast(blocks), "_block", "left").withColumn("_bits", F.try_element_at("_words", word))
            bit = lambda m: F.coalesce(F.getbit(F.col("_bits")[m], F.expr("CAST(doc_id & 63 AS INT)")), F.lit(0)).cast("int")
            return found.select(*rows.columns, *[bit(m).alias(m) for m in marks])
    found = lookup(rows, said.select("doc_id", *marks), "doc_id", "doc_id")
    return found.select(*rows.columns, *[F.coalesce(m, F.lit(0)).alias(m) for m in marks])


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: the array of all buckets' log ratios, add-one smoothed, in 1/SCALE."""
    marked = with_marks(docs.select("doc_id", "text"), labels, ["trusted"])
    marked = marked.select(words_of(F.col("text")).alias("_w"), "trusted")
    rows = marked.select(F.explode(features(F.col("_w"), buckets)).alias("bucket"), "trusted")
    counts = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target")), "bucket-counts")
    sums = counts.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    all_buckets = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = all_buckets.join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    ratio = F.log((F.col("target") + 1) / (F.coalesce("targets", F.lit(0)) + buckets)) - F.log((F.col("raw") + 1) / (F.coalesce("raws", F.lit(0)) + buckets))
    scaled = F.round(ratio * SCALE).cast("int").alias("w")
    return full.join(F.broadcast(sums)).agg(F.sort_array(F.collect_list(F.struct("bucket", scaled)))["w"].alias("ratios"))


def judge(docs: DataFrame, labels: DataFrame, out: str = "verdict", buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with a struct column ``out`` of the counts, the score and ``kept``.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` needs ``doc_id``, ``quality`` and ``toxic``.  A null text has no
    words and is not kept.  Rows are judged one by one, so repeated rows and ids and null ids stay; ids labelled more than
    once count by their worst label, null labels not at all.  A column of ``docs`` named ``out`` is replaced.  Without
    labels of both kinds the threshold is ``DEFAULT_THRESHOLD``.
    """
    spark = docs.sparkSession
    said = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id")).agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    ).select("doc_id", F.lit(1).alias("labelled"), (F.col("quality") != 0).cast("int").alias("good"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("trusted"))
    said = materialise(said, "labels")
    # The table has a fixed number of small integers; as a constant of the plan it needs no join and no shuffle of texts.
    ratios = log_ratios(docs, said.select("doc_id", "trusted"), buckets).first()["ratios"]
    table = F.split(F.lit(" ".join(map(str, ratios))), " ").cast("array<int>")

    def score(words: Column) -> Column:
        ids = features(words, buckets)
        total = F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, b: a + F.get(table, b))
        return F.when(F.size(words) > 0, total / (2 * SCALE * F.size(words)))

    known = with_marks(docs.select("doc_id", "text"), said, ["labelled", "good"]).where("labelled = 1")
    known = known.select(words_of(F.col("text")).alias("_w"), "good").select(F.floor(score(F.col("_w")) / GRID).alias("bin"), "good")
    binned = known.groupBy("bin").agg(F.count_if(F.col("good") == 0).alias("bad"), F.count_if(F.col("good") == 1).alias("good"))
    threshold = _best_cut([r for r in binned.collect() if r["bin"] is not None])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = {c: f"_{k}" for k, c in enumerate(docs.columns) if c != out}
    kept_columns = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("text"))
    t = kept_columns.withColumn("_t", text).drop("text").withColumn("_w", words_of(F.col("_t")))
    t = t.withColumn("_h", window_hashes(F.col("_w"))).withColumn("_o", _ordered(F.col("_h"))).withColumn("_p", _repeated_places(F.col("_o")))
    t = t.withColumns(base_rules(t, F.col("_w"), F.col("_t")) | {"n_repeat_words": _coverage(F.col("_p")).cast("long"), "score": score(F.col("_w"))})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    t = t.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= F.lit(threshold), F.lit(False)))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return t.select(*[F.col(n).alias(c) for c, n in names.items()], F.struct(*fields).alias(out))


def _best_cut(bins: list) -> float:
    """Lower edge of the bin below which rejecting gains most; the lowest such edge. Bins are a fixed grid of scores."""
    good, bad = sum(r["good"] for r in bins), sum(r["bad"] for r in bins)
    if not good or not bad:
        return DEFAULT_THRESHOLD
    best, cut, g, b = 0.0, DEFAULT_THRESHOLD, 0, 0
    for r in sorted(bins, key=lambda r: r["bin"]):
        g, b = g + r["good"], b + r["bad"]
        gain = b / bad - CAUTION * g / good
        if gain > best:
            best, cut = gain, (r["bin"] + 1) * GRID
    return cut
