import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from marklens.llm import queries
from marklens.llm.components import components
from marklens.llm.jaccard import join

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= 80 * max(len(sets[a]), len(sets[b])):
                c = len(sets[a] & sets[b])
                if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows, line = [], " ".join(r.choice(vocab) for _ in range(40))
    for i in range(260):
        if rows and r.random() < 0.6:
            w = (r.choice(rows)[1] or "").split()
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.2:
                w += r.choices(vocab, k=r.randint(1, 9))
        else:
            w = r.choices(vocab, k=r.choice([1, 3, 4, 5, 6, 30, 80, 200]))
        rows.append((i * 7 % 263, " ".join(w) + (f"\n{line}" if r.random() < 0.4 else "")))
    return rows


ODD = [(1000, None), (1001, ""), (1002, " \n"), (1003, "Four words Only here"), (1004, "four words only HERE"), (1005, "é É"), (1006, "é é"), (1007, "word " * 30000), (1008, "WORD " * 9)]


@pytest.mark.parametrize("case", ["near1", "near2", "real"])
def test_components(spark, sf, case):
    rows = [(r.doc_id + 2000, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] if case == "real" else near_copies(case)
    rows = rows + ODD
    df = spark.createDataFrame(rows + [(None, "no id"), (1003, "Four words Only here")], "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("component_id", F.lit(3)).repartition(6)
    got = join(df).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute(rows)


def test_empty(spark):
    assert join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_of_links(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 7), (5, 5), (9, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 161)} | {3: 3, 7: 3, 9: 3}


def test_query_against_sql(spark, sf):
    df = queries.op1_ngram_jaccard_join(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cur = con.execute(queries.TWINS["op1_ngram_jaccard_join"])
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
