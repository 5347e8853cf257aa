import random
import re

import pytest
from pyspark.sql import functions as F

from marklens.llm.licenses import SHARE, TEMPLATES, K, scan


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return [tuple(w[i : i + K]) for i in range(len(w) - K + 1)], len(w)


def brute(docs, templates):
    out = {}
    for i, t in docs:
        h, _ = shingles(t or "")
        for name, body in templates.items():
            own, n = set(shingles(body)[0]), shingles(body)[1]
            c = 1 << (n - 1).bit_length()
            for lo in range(0, len(h), c):
                share = len(own & set(h[lo : lo + 2 * c - K + 1])) / len(own)
                if share >= SHARE:
                    old = out.get((i, name), (0, lo))
                    out[i, name] = (max(old[0], share), min(old[1], lo))
    return out


def test_against_brute_force(spark, sf):
    r = random.Random(6)
    real = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = list(real) + [(5000, None), (5001, ""), (5002, "mit"), (5003, "Released under the MIT License."), (5003, "Released under the MIT License."), (None, TEMPLATES["bsd"])]
    for k, (name, body) in enumerate(sorted(TEMPLATES.items())):
        for j in range(4):
            w = body.split()
            if j > 1 and len(w) > 60:
                w[r.randrange(len(w))] = "changed"
            filler = [r.choice(real)[1] or "" for _ in range(2)]
            rows.append((6000 + 10 * k + j, f"{filler[0][: 400 * j]} {' '.join(w).upper() if j == 1 else ' '.join(w)}\n{filler[1]}"))
    rows.append((7000, "word " * 30000 + TEMPLATES["mit"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash")).withColumn("size", F.lit(2)).repartition(4)
    got = {(x.doc_id, x.license): (x.share, x.first_word) for x in scan(df).collect()}
    want = brute(rows, TEMPLATES)
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 or got[k][0] >= SHARE for k in got)
    assert {k for k, v in want.items() if v[0] == 1} <= set(got)


def test_empty_and_short_templates(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert scan(none).count() == 0
    with pytest.raises(ValueError):
        scan(none, {"short": "only four words here"})


def test_every_surrounding_of_a_short_template(spark):
    """Whole occurrences at every offset, with different words around: all found, as brute force finds them."""
    r = random.Random(7)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    nine = {"nine": "one two three four five six seven eight nine", "mit-line": TEMPLATES["mit-line"]}
    rows = [(i, f"{words(r.randint(0, 40))} {nine['nine' if i % 3 == 0 else 'mit-line']} {words(r.randint(0, 40))}") for i in range(6000)]
    rows += [(6000 + i, f"{words(i)} {body} {words(r.randint(0, 300))}") for i, body in enumerate(sorted(TEMPLATES.values()) * 20)]
    every = TEMPLATES | nine
    got = {(x.doc_id, x.license): (x.share, x.first_word) for x in scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), every).collect()}
    assert got == brute(rows, every)
