import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from marklens.llm.quality import CAUTION, DEFAULT_THRESHOLD, GRID, SCALE, judge

WORD = re.compile("[^\x20\x09-\x0d]+")
NB = 1 << 10


def fold(*parts):
    seed = 42
    for p in parts:
        if p is not None:
            seed = xxhash.xxh64_intdigest(p.encode(), seed=seed)
    return seed % NB if seed < 1 << 63 else (seed - (1 << 64)) % NB


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(wins)
    covered = {i + j for i, w in enumerate(wins) if seen[w] > 1 for j in range(3)}
    return words, (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def feats(words):
    return [fold(w) for w in words] + [fold(a, b) for a, b in zip(words, [*words[1:], None], strict=False)]


def brute(docs, labels):
    worst = {}
    for i, q, t in labels:
        if i is not None and q is not None:
            a = worst.get(i, (1, 0))
            worst[i] = (min(q, a[0]), max(t or 0, a[1]))
    raw, target = Counter(), Counter()
    for i, t in docs:
        f = feats(base(t)[0])
        raw.update(f)
        if worst.get(i) == (1, 0):
            target.update(f)
    n, m = target.total() + NB, raw.total() + NB
    ratio = [(math.log((target[b] + 1) / n) - math.log((raw[b] + 1) / m)) * SCALE for b in range(NB)]
    w = [math.copysign(math.floor(abs(x) + 0.5), x) for x in ratio]
    score = lambda ws: sum(w[b] for b in feats(ws)) / (2 * SCALE * len(ws)) if ws else None
    good, bad = Counter(), Counter()
    for i, t in docs:
        if i in worst and (s := score(base(t)[0])) is not None:
            (bad if worst[i][0] == 0 else good)[math.floor(s / GRID)] += 1
    best, cut, g, b = 0.0, DEFAULT_THRESHOLD, 0, 0
    if good and bad:
        for k in sorted({*good, *bad}):
            g, b = g + good[k], b + bad[k]
            if b / bad.total() - CAUTION * g / good.total() > best:
                best, cut = b / bad.total() - CAUTION * g / good.total(), (k + 1) * GRID
    out = []
    for i, t in docs:
        ws, n = base(t)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        s = score(ws)
        out.append((i, *n, failed, not failed and s is not None and s >= cut, s))
    return out


ODD = [
    (None, "no id " * 60), (1, None), (1, ""), (1, ""), (2, " \n\t "), (3, "a b"), (4, "a b c a b c"), (5, "x x x x"), (6, "line one\nline one\n\n \nline one x"),
    (7, "é ü 日本 # * $ % & | < > #"), (8, " ".join(str(i) for i in range(49))), (9, " ".join(str(i) for i in range(50))), (10, "w " * 30000),
    (11, "A\x0bB\x0cC D\u0085E " * 20), (12, "q w e r t " * 11), (13, "".join(chr(97 + i % 26) for i in range(100000))),
]


@pytest.mark.parametrize("labelled", [True, False])
def test_against_brute_force(spark, sf, labelled):
    real = [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id + 100, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()] + [(None, 1, 0), (9, 1, None), (9, 1, 1), (8, None, None)]
    docs, labels = (ODD + real, labels) if labelled else (ODD, [])
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("verdict", F.lit(0)).repartition(4)
    got = judge(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), buckets=NB).collect()
    want = brute(docs, labels)
    assert got[0].n_words == "clash"
    key = lambda r: (r[0] is None, *(x if x is not None else -9 for x in r[1:6]), r[0] or 0, r[6], r[7])
    rows = sorted(((r.doc_id, r.verdict.n_words, r.verdict.word_chars, r.verdict.n_symbols, r.verdict.n_dup_lines, r.verdict.n_repeat_words, r.verdict.base_failed, r.verdict.kept, r.verdict.score) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:8] for r in rows] == [r[:8] for r in want]
    for a, b in zip(rows, want, strict=True):
        assert (a[8] is None) == (b[8] is None) and (a[8] is None or abs(a[8] - b[8]) < 1e-9)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert judge(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_labels_are_parted(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = judge(docs, labels).join(labels, "doc_id").where("verdict.n_words >= 50").groupBy("quality").agg(F.avg(F.col("verdict.kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.98 and kept[0] < 0.1


def test_every_label_counts(spark):
    """30,000 labelled documents, good and bad ones of two kinds of text; the cut lies where all of them put it."""
    n = 30_000
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    good = F.pmod(F.col("doc_id"), F.lit(2)) == 0
    word = lambda i: F.concat(F.when(good, "g").otherwise("b"), F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(40)).cast("string"))
    docs = ids.select("doc_id", F.concat_ws(" ", *[word(i) for i in range(3)]).alias("text"))
    labels = ids.select("doc_id", good.cast("int").alias("quality"), F.lit(0).alias("toxic"))
    seen = []
    from marklens.llm import quality

    plain = quality._best_cut
    quality._best_cut = lambda bins: seen.append((sum(r["good"] for r in bins), sum(r["bad"] for r in bins))) or plain(bins)
    try:
        judge(docs, labels, buckets=NB)
    finally:
        quality._best_cut = plain
    assert seen == [(n // 2, n // 2)]


@pytest.mark.parametrize("blocks", [1 << 12, 1])
def test_marks(spark, monkeypatch, blocks):
    """Bits and looked up labels agree; neither shuffles texts nor sends a row per label while ids lie close."""
    from marklens.llm import quality

    monkeypatch.setattr(quality, "BLOCKS", blocks)
    said = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in [*range(-70, 9000, 2), 1 << 40, (1 << 63) - 1, -(1 << 63)]]
    ids = [None, *range(-80, 9100), 1 << 40, (1 << 40) + 1, (1 << 63) - 1, -(1 << 63)]
    rows = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    out = quality.with_marks(rows, spark.createDataFrame(said, "doc_id long, a int, b int"), ["a", "b"])
    want = {i: (a, b) for i, a, b in said}
    assert {r.doc_id: (r.a, r.b) for r in out.collect()} == {i: want.get(i, (0, 0)) for i in ids}


def test_labels_are_no_rows_of_a_broadcast(spark):
    """The table that meets the texts has a row per 4,096 ids, so it does not grow the driver with the corpus."""
    from marklens.llm import quality

    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    out = quality.with_marks(ids.withColumn("text", F.lit("x")), ids.withColumn("trusted", F.lit(1)), ["trusted"])
    assert out.agg(F.sum("trusted")).first()[0] == 20_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 1 and "_block" in plan
