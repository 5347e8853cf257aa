import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklens.llm.katz import K, discounts, score

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), 0]


def model(texts):
    """Brute force: (P of a token after a history, counts)."""
    one, two = Counter(), defaultdict(Counter)
    for t in texts:
        for h, w in zip([1, *t], t):
            one[w] += 1
            two[h][w] += 1
    spec = lambda counts: np.array([sum(c == r for c in counts) for r in range(1, K + 2)])
    d1, d2 = discounts(spec(list(one.values()))), discounts(spec([c for s in two.values() for c in s.values()]))
    N = sum(one.values())
    left = sum((1 - d1[min(c, K + 1)]) * c for c in one.values())

    def p1(w):
        if not left:
            return (one[w] if one[w] else 1) / (N + 1)
        return d1[min(one[w], K + 1)] * one[w] / N if one[w] else left / N

    weights = {}
    for h, s in two.items():
        c = sum(s.values())
        rest = sum((1 - d2[min(x, K + 1)]) * x for x in s.values())
        free = 1 - sum(p1(w) for w in s)
        weights[h] = (rest / c / free, 1.0) if rest else (1 / (c + 1) / free, c / (c + 1))

    def p(h, w):
        if h not in two:
            return p1(w)
        a, scale = weights[h]
        c = two[h][w]
        return scale * d2[min(c, K + 1)] * c / sum(two[h].values()) if c else a * p1(w)

    return p, one, N, two


def rows_of(case, spark, sf):
    r = random.Random(4)
    odd = [(900, None), (901, ""), (902, " \n "), (903, "é É one ONE"), (904, "a " * 20000), (905, "x"), (905, "x"), (906, "never seen before words")]
    if case == "real":
        return odd + [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    if case == "tiny":
        return [(1, "a b"), (2, "c")]
    vocab = [f"w{i}" for i in range(50)]
    return odd + [(i, " ".join(r.choices(vocab, weights=[1 / (k + 1) ** 2 for k in range(50)], k=r.randint(0, 30)))) for i in range(300)]


@pytest.mark.parametrize("case", ["zipf", "real", "tiny"])
def test_against_brute_force(spark, sf, case):
    rows = rows_of(case, spark, sf)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("part", F.lit(1)).repartition(5)
    got = score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    p, one, N, two = model([tokens(t) for i, t in rows if not held(i)])
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        toks, r = tokens(t), by[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(toks), sum(one[w] > 0 for w in toks), N)
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 1) / (N + len(one) + 1)) for w in toks), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(h, w)) for h, w in zip([1, *toks], toks)), rel_tol=1e-9), i
    for h in list(two)[:20] + ["never"]:  # exactly normalised over all known words and one unseen
        assert math.isclose(sum(p(h, w) for w in one) + p(h, "never seen"), 1, rel_tol=1e-9)


def test_fits_better_than_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    r = out.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_empty_and_all_held_out(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert score(none, F.lit(False)).count() == 0
    r = score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
