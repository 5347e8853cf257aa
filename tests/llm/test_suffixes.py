import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marklens.llm.suffixes import _decoded, _front_coded, deduplicate, merged


def brute(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        spans, i = [], 0
        while i < len(t):
            if mark[i]:
                j = i
                while j < len(t) and mark[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out.append((len(t), spans, bytes(b for b, m in zip(t, mark, strict=True) if not m)))
    return out


def check(spark, texts, length, parts=4):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit("x")).withColumn("part", F.lit(9)).repartition(parts, "doc_id")
    got = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.removed], bytes(r.kept)) for r in deduplicate(df, length).collect()}
    want = brute(texts, length)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, got[i][:2], w[:2])


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    words = [f"{chr(97 + i % 26)}é{i}" for i in range(300)]
    blocks = [" ".join(r.choices(words, k=r.randint(5, 60))) for _ in range(30)]
    texts = [None, "", "short", "ab" * 3000, "ab" * 50, "x" * 39, "y" * 40, "y" * 41, "z" * 2000]
    for _ in range(150):
        body = " ".join(r.choice(blocks) if r.random() < 0.4 else " ".join(r.choices(words, k=r.randint(1, 40))) for _ in range(r.randint(1, 8)))
        if texts[-1] and r.random() < 0.4:  # a near copy
            old = r.choice(texts[9:] or [body])
            at = r.randrange(len(old))
            body = old[:at] + r.choice(["", "Q", "é"]) + old[at + r.randint(0, 2) :]
        texts.append(body)
    texts += texts[-3:]
    check(spark, texts, 40)


def test_documents(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    check(spark, texts, 400, parts=3)


def test_empty(spark):
    assert deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merge_keeps_order_and_shared_lengths():
    r = random.Random(3)
    for n in (1, 2, 3, 5, 8):
        runs = [sorted({bytes(r.choices(b"ab", k=r.randint(0, 12))) for _ in range(r.randint(0, 40))}) for _ in range(n)]
        coded = [_decoded(_front_coded(x, [1] * len(x))) for x in runs]
        left = [iter(x) for x in runs]
        out, last = [], b""
        for k, size, shared, times in merged(coded):
            s = next(left[k])
            assert len(s) == size and times == 1
            n_same = next((i for i, (p, q) in enumerate(zip(last, s, strict=False)) if p != q), min(len(last), len(s)))
            assert shared == n_same and last <= s
            out.append(s)
            last = s
        assert out == sorted(sum(runs, []))
