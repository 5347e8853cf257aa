import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from marklens.llm import pii, queries


def brute(text):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) < 4 and int(p) % 1000 <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(a, k, b) for a, _, k, b in sorted(out)]


def test_base_against_patterns(spark, sf):
    r = random.Random(9)
    bits = ["a@b.c", "@", "x.y", "-", "+", "1.2.3.4", "256", ".", "4111111111111111", "4111 1111-1111 1111", "+1 (988) 555-2485", " ", "  ", "é", "日", "9", "00", "(", ")", "%", "a@b", "@b.c.", "\n", "+44", "٣"]
    odd = [None, "", "@", "a@@b.c", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "1.2.3.256", "0" * 5000 + "1.1.1.1", "12" * 6000, "+" + "1" * 16, "x" * 80000 + " q@w.e"]
    texts = odd + ["".join(r.choices(bits, k=r.randint(0, 25))) for _ in range(1200)] + [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = list(enumerate(texts)) + [(None, "a@b.c"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1)).repartition(3)
    got = queries._span_digests(pii.scan(df), pii.BASE).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    for i, t in rows:
        want = brute(t or "")
        digest = ",".join(f"{k}:{a}:{b}" for a, k, b in want)
        assert by[i].base_sha256 == hashlib.sha256(digest.encode()).hexdigest(), (i, t, by[i].spans)
        assert (by[i].n_email, by[i].n_ip, by[i].n_card, by[i].n_phone) == tuple(sum(s[1] == k for s in want) for k in pii.BASE)
        assert set(filter(None, digest.split(","))) <= set(by[i].spans.split(","))


def test_repeated_tokens_follow_their_twins(spark):
    """A phone number without its country code is taken for one where it repeats a full one, and left alone elsewhere."""
    r = random.Random(4)
    rows, filler = [], "then the other went on and on".split()
    for i in range(400):
        n = f"{r.randint(200, 999)}-555-{r.randint(1000, 9999)}"
        text = f"{' '.join(r.choices(filler, k=9))} +1-{n} {' '.join(r.choices(filler, k=40))} +1-{n} {' '.join(r.choices(filler, k=5))} {r.randint(1, 99)} cats"
        rows.append((i, text))
    field = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    twin, lone = "call +1-321-555-7788 or write, then ask for 321-555-7788 again +1-321-555-7788", "room 321-555-7788 here"
    probe = lambda t: {(k, t[a:b]) for a, k, b in pii._found(field, [t])[0]}
    assert ("phone", "+1-321-555-7788") in probe(twin)
    p = lambda t: field.posteriors([g := pii._Graph(t, pii.base_spans(t))])[[s == "321-555-7788" for s in (t[a:b] for a, b in g.spans)], 4][0]
    assert p(twin) > p(lone)
    assert probe(lone) == set()


def test_exact_on_a_chain():
    """On a chain without skip edges belief propagation is exact."""
    r = np.random.default_rng(3)
    field = pii.Field(r.normal(size=(128, 5)), r.normal(size=(5, 5)), r.normal(size=(5, 5)))
    g = pii._Graph("1 22 a@b +5", [])
    assert g.chain == [(0, 1), (1, 2), (2, 3)] and not g.skip
    theta = np.array([field.node[f].sum(axis=0) for f in g.features])
    total = np.zeros((4, 5))
    for a in np.ndindex(5, 5, 5, 5):
        w = np.exp(sum(theta[i, a[i]] for i in range(4)) + sum(field.chain[a[i], a[i + 1]] for i in range(3)))
        for i in range(4):
            total[i, a[i]] += w
    pii_rounds = field.posteriors([g])
    assert np.allclose(pii_rounds, total / total.sum(axis=1, keepdims=True), atol=0.02)


def test_empty(spark):
    assert pii.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
