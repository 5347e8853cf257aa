import random
import re

import pytest
from pyspark.sql import functions as F

from marklens.llm.decontaminate import clean, matches

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    out = []
    for w in WORD.findall(text or ""):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
        w = re.sub(r"^[\x00-\x7f]*?(?=[0-9a-z\x80-\U0010ffff]|$)", "", w)
        w = re.sub(r"[^0-9a-z\x80-\U0010ffff]+$", "", w)
        if w:
            out.append(w)
    return out


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")


def test_whole_passages_are_found_and_others_left(spark, tables):
    docs, bench = tables
    items = {r.item_id: " ".join(plain(r.text)) for r in bench.collect()}
    texts = {r.doc_id: f" {' '.join(plain(r.text))} " for r in docs.collect()}
    want = {(d, i) for d, t in texts.items() for i, w in items.items() if f" {w} " in t}
    got = {(r.doc_id, r.item_id): r for r in matches(docs, bench).collect()}
    assert want and want <= set(got)
    assert all(got[k].common == 1 and got[k].answer == 1 for k in want)
    assert len({d for d, _ in set(got) - want}) <= 0.01 * len(texts)
    kept = {r.doc_id for r in clean(docs, bench).collect()}
    assert kept == set(texts) - {d for d, _ in got}


def test_paraphrases(spark, tables):
    """Items with a fifth of their words changed, dropped or added, inside other documents: recall of at least 0.9."""
    docs, bench = tables
    r = random.Random(5)
    pool = [w for d in docs.limit(50).collect() for w in (d.text or "").split()]
    rows, n = [], 0
    for item in bench.collect():
        w = item.text.split()
        if len(w) < 15:
            continue
        out = []
        for x in w:
            u = r.random()
            out += [] if u < 0.07 else [r.choice(pool)] if u < 0.14 else [x, r.choice(pool)] if u < 0.2 else [x]
        rows.append((10_000 + item.item_id, " ".join(r.choices(pool, k=r.randint(0, 400)) + out + r.choices(pool, k=r.randint(0, 400)))))
        n += 1
    more = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(x.doc_id, x.item_id) for x in matches(more, bench).collect()}
    assert sum((10_000 + i, i) in got for i in range(1000)) >= 0.9 * n


def test_odd_rows(spark, tables):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six seven eight nine ten"), (3, "one two three four five six seven eight nine ten"), (None, "x y z"), (5, "short one"), (6, "... !!")], "item_id long, text string").withColumn("answer", F.lit("clash"))
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "One, two three FOUR five six seven eight nine. Ten"), (3, "One, two three FOUR five six seven eight nine. Ten"), (None, "one two three four five six seven eight nine ten"), (4, "short"), (5, "a short one"), (6, "word " * 50000)],
        "doc_id long, text string",
    ).withColumn("item_id", F.lit("clash")).repartition(3)
    got = sorted((r.doc_id or -1, r.item_id) for r in matches(docs, bench).collect())
    assert got == [(-1, 3), (-1, 3), (3, 3), (3, 3), (3, 3), (3, 3), (5, 5)]
    left = clean(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 4, 6]
    assert matches(docs.limit(0), bench).count() == 0 and matches(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1000, 3000])
def test_many_items(spark, tables, n):
    """The last items of a long benchmark: exact copies of 7, 10 and more words all found, paraphrases at 0.9 or more."""
    docs, _ = tables
    r = random.Random(n)
    more = [plain(x.text) for x in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(3000).collect()]
    more = [w for w in more if len(w) >= 60]
    pool = [w for d in docs.limit(50).collect() for w in (d.text or "").split()]
    items, rows, exact, changed = [], [], set(), set()
    for i in range(n):
        w = r.choice(more)
        size = r.choice([7, 10, 30, 50])
        at = r.randrange(len(w) - size + 1)
        w = w[at : at + size]
        items.append((i, " ".join(w)))
        if i < n - 150:
            continue
        (exact if size < 15 or i % 2 else changed).add((20_000 + i, i))
        if (20_000 + i, i) in changed:
            w = [y for x in w for u in [r.random()] for y in ([] if u < 0.07 else [r.choice(pool)] if u < 0.14 else [x, r.choice(pool)] if u < 0.2 else [x])]
        rows.append((20_000 + i, " ".join(r.choices(pool, k=r.randint(0, 200)) + w + r.choices(pool, k=r.randint(0, 200)))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    every = docs.select("doc_id", "text").limit(300).union(spark.createDataFrame(rows, "doc_id long, text string")).repartition(8)
    got = {(x.doc_id, x.item_id) for x in matches(every, bench).collect()}
    assert exact <= got
    assert len(changed & got) >= 0.9 * len(changed)


def test_items_of_common_words(spark, tables):
    """Words in more than a twentieth of the passages: found word after word in a large corpus as in a small one."""
    docs, _ = tables
    text = "alpha beta gamma delta epsilon zeta eta theta iota"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    common = docs.select((F.col("doc_id") + 50_000).alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(" ".join(reversed(text.split())) + " "), F.substring("text", 1 + 300 * k, 300)) for k in range(5)]).alias("text"))
    own = spark.createDataFrame([(1, f"before it {text} and after"), (2, text.replace("delta", "delta x"))], "doc_id long, text string")
    assert {x.doc_id for x in matches(common.union(own), bench).collect()} == {1}
    assert 1 in {x.doc_id for x in matches(common.limit(3).union(own), bench).collect()}


def test_items_without_id_count(spark):
    """A passage is a leak whether or not its item has an id."""
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "nothing of it here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage)], "item_id long, text string")
    assert [r.doc_id for r in clean(docs, bench).collect()] == [2]
    assert [(r.doc_id, r.item_id) for r in matches(docs, bench).collect()] == [(1, None)]
