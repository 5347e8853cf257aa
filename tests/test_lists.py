"""Features of token, sentence and match lists against those of the tables, and what they cost."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from marklens.functions import scalars as S
from marklens.functions import text as X
from marklens.operators import agreement as A
from marklens.operators import features as T
from marklens.plans import text_views as V
from marklens.session import TEXT_ROWS, materialise

ALL = ("sent_id", "sent_pos", "tok_i", "text", "is_alpha", "piece_length", "lemma", "pos", "dep", "head_i")


def close(a, b):
    a, b = (sorted(map(tuple, x.collect())) for x in (a, b))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=1e-9)


def test_lists_give_the_features_of_the_tables(spark, sf):
    t = materialise(V.tokens(spark, sf), "tokens")
    lists = V.with_matches(T.sentence_spans(V.lists(spark, sf, *ALL)), placed=True)
    lexicon, matches = T.lexicon_of(t), V.matches_of(t)
    close(T.list_core_features(lists), T.core_features(t, V.sentences(spark, sf), matches, lexicon))
    close(T.list_extra_features(lists), T.extra_features(t, matches, lexicon))
    words = T.list_words(V.lists(spark, sf, *ALL), content=True)
    close(T.list_mean_frequency(words, lexicon, limit=3).select("doc_id", "mean_word_frequency"), T.mean_word_frequency(t, lexicon))
    names = ["doc_id", "content_word_low_frequency_ratio", "content_word_frequency_p25"]
    close(T.list_content_frequencies(words, lexicon, limit=3).select(names), T.content_frequencies(t, lexicon))
    edits = V.with_edits(T.list_sentences(V.lists(spark, sf, *ALL)))
    flat = A.edit_counts(V.edits(spark, sf), V.sentences(spark, sf))
    as_text = F.to_json("per_type")
    assert sorted(map(tuple, A.list_edit_counts(edits).withColumn("per_type", as_text).drop("clean_sentence_share").collect())) == sorted(
        map(tuple, flat.withColumn("per_type", as_text).select("doc_id", "sentences", "edits_all", "edits_grammar", "per_type").collect()))


@pytest.mark.parametrize("name", [
    "d4_mtld", "d5_mattr", "d9_noun_diversity", "d10_grammar_rate", "d11_error_free_sentences", "d15_content_lemma_mattr", "d16_misspelling_rate",
    "d17_rule_diversity", "d19_tree_depth", "m13_edit_counts",
])
def test_no_table_of_tokens_is_shuffled(spark, sf, name):
    plan = entry_point.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("_nfkc") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= TEXT_ROWS


def test_depths_with_cycles():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(1, 4))]
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        index = np.arange(len(sentence))
        heads = np.array([rng.randint(0, len(index)) for _ in index])
        alpha = np.array([rng.random() < 0.8 for _ in index])
        want = [X._depth(index[sentence == s], heads[sentence == s], alpha[sentence == s]) for s in range(len(sizes))]
        assert X._depths(sentence, index, heads, alpha) == pytest.approx(np.mean(want))


def test_untouched_sentences(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        cuts = sorted(rng.sample(range(60), 8))
        spans = list(zip(cuts[::2], cuts[1::2]))
        found = [(a := rng.randint(0, 60), a + rng.randint(1, 9)) for _ in range(rng.randint(0, 4))]
        share = sum(not any(a < e and b > s for a, b in found) for s, e in spans) / len(spans)
        rows.append((i, *map(list, zip(*spans)), [a for a, _ in found], [b for _, b in found], share))
    df = spark.createDataFrame(rows, "i int, s array<long>, e array<long>, a array<long>, b array<long>, share double")
    got = df.select(X.untouched("s", "e", "a", "b").alias("got"), "share").collect()
    assert all(r["got"] == pytest.approx(r["share"]) for r in got)


def test_arrivals_have_a_file_per_split(spark, sf, monkeypatch):
    from marklens.plans import stream_queries as Q

    monkeypatch.setattr(Q, "table", lambda spark, sf, name: spark.read.parquet(f"{sf}/{name}.parquet").repartition(9))
    base, _ = Q._arrivals(spark, sf, True)
    assert spark.read.parquet(base).select(F.input_file_name()).distinct().count() > 9


def test_squeeze_takes_every_run(spark):
    spaces = [" ", "  ", "\t", "\n ", " \u00a0", "\u2003", "\u3000\u3000", "\x0b", "\x85", "\u2028 "]
    rng = random.Random(6)
    texts = ["".join(rng.choice(spaces) + rng.choice(["a", "\u00e9b", ""]) for _ in range(9)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select(S.squeeze(F.col("text")).alias("got"), F.btrim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("want")).collect()
    assert all(r["got"] == r["want"] == " ".join(texts[i].split()) for i, r in enumerate(got))
