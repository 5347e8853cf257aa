"""Fingerprints, hash trees and file digests."""

import hashlib
import math

import duckdb
from pyspark.sql import functions as F

from marklens.operators import duplicates as U
from marklens.plans import registry
from marklens.plans import catalogue  # noqa: F401  (registers every query)
from marklens.sources import tables as IO


def _tree(ids, most, bucket):
    digits = 0
    while most > bucket * 16**digits:
        digits += 1
    level = {}
    for i in sorted(ids):
        level.setdefault(hashlib.md5(i.encode()).hexdigest()[:digits], []).append(i)
    level = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in level.items()}
    while True:
        digits = max(0, digits - 2)
        up = {}
        for k in sorted(level):
            up.setdefault(k[:digits], []).append(level[k])
        level = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in up.items()}
        if not digits:
            return level[""]


def test_hash_tree_of_every_depth(spark, monkeypatch):
    rows = [(g, f"id{i}") for g, n in (("a", 900), ("b", 3), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i string")
    for bucket in (2000, 100, 8, 1):
        monkeypatch.setattr(IO, "IDS_PER_BUCKET", bucket)
        got = {r.g: (r.ids, r.digest) for r in IO.ordered_id_digest(df, "i", ["g"]).collect()}
        want = {g: (n, _tree([f"id{i}" for i in range(n)], 900, bucket)) for g, n in (("a", 900), ("b", 3), (None, 40))}
        assert got == want
    less = {r.g: r.digest for r in IO.ordered_id_digest(df.where("i <> 'id7' or g is null"), "i", ["g"]).collect()}
    assert less["a"] != got["a"][1] and less[None] == got[None][1]


def test_fingerprint_sees_one_changed_row_and_no_order(spark):
    df = spark.range(500).select("id", F.concat(F.lit("t"), F.col("id")).alias("t"))
    one = IO.table_fingerprint(df, ["id", "t"]).first()
    assert one == IO.table_fingerprint(df.orderBy(F.desc("id")).repartition(7), ["id", "t"]).first()
    changed = df.withColumn("t", F.when(F.col("id") == 77, "x").otherwise(F.col("t")))
    other = IO.table_fingerprint(changed, ["id", "t"]).first()
    assert other.rows == one.rows and other.digest_sum != one.digest_sum and other.digest_xor != one.digest_xor
    assert len(one.digest_xor) == 32 and one.digest_sum.count(":") == 3
    twice = IO.table_fingerprint(df.union(df), ["id", "t"]).first()
    assert twice.digest_xor == "0" * 32 and twice.digest_sum != one.digest_sum


def test_file_bytes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc" * 1000)
    (tmp_path / "empty.bin").write_bytes(b"")
    got = {r.file: (r.bytes, r.sha256) for r in IO.file_bytes(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": (3000, hashlib.sha256(b"abc" * 1000).hexdigest())}


def test_frequent_term_is_never_a_key_by_itself(spark, monkeypatch):
    monkeypatch.setattr(U, "_POSTINGS", 8)
    rows = [(i, f"sharedword unique{i:04d}x" if i < 60 else f"other{i // 2}abc text{i // 2}def") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, t string")
    vectors, _ = U.shingle_vectors(df.where("id < 60 or id % 2 = 0").union(df.where("id = 61").selectExpr("id", "concat(t, ' a')")), "id", "t")
    prefixes = U._prefixes(vectors, 0.1)
    counts = prefixes.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("_k").alias("k"), F.min("_k").alias("least")).collect()
    assert max(r.n for r in counts) > 16 and all(r.k == r.least and r.k >= math.ceil(r.n / 8) for r in counts)
    got = {(r.a, r.b) for r in U.near_pairs(vectors, 0.3).collect()}
    each = {r.rep: dict(zip(r.t, r.w)) for r in vectors.collect()}
    dot = lambda a, b: round(sum(w * each[b].get(t, 0.0) for t, w in each[a].items()), 9)
    want = {(a, b) for a in each for b in each if a < b and dot(a, b) >= 0.3}
    assert got == want and len(want) > 100


def test_digest_twin_of_three_levels(spark, sf, monkeypatch):
    """Buckets of one id on average need two digits or more, so the twin has to climb the tree as the query does."""
    con = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf.replace('0.001', '0.01')}/{t}.parquet')")
    monkeypatch.setattr(IO, "IDS_PER_BUCKET", 4)
    sql = registry.TWINS["a11_ordered_id_digest"]
    assert "1024.0" in sql
    want = sorted(con.execute(sql.replace("1024.0", "4.0")).fetchall())
    got = registry.QUERIES["a11_ordered_id_digest"](spark, sf.replace("0.001", "0.01"))
    assert sorted(tuple(r) for r in got.select("cv_fold", "ids", "digest").collect()) == want


def test_rare_and_frequent_terms_get_the_same_weights(spark, sf, monkeypatch):
    """A dictionary beyond the broadcast part is met by term, without copies of it, and gives the same vectors."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 2000").limit(60).localCheckpoint()
    whole, members = (x.toPandas().sort_values(["rep", *(["doc_id"] if i else [])]).reset_index(drop=True) for i, x in enumerate(U.shingle_vectors(docs, "doc_id", "text")))
    monkeypatch.setattr(U, "_FREQUENT", 50)
    vectors, again = U.shingle_vectors(docs, "doc_id", "text")
    got = vectors.toPandas().sort_values("rep").reset_index(drop=True)
    assert (got["rep"] == whole["rep"]).all() and all(list(a) == list(b) for a, b in zip(got["t"], whole["t"]))
    assert all(max(abs(a - b)) < 1e-12 for a, b in zip(got["w"], whole["w"]))
    assert len(members) == docs.where("text is not null").count() == again.count()
    idf = spark.range(1, 1001).selectExpr("cast(id as string) as term", "id as tid", "1 as k", "1.0D as _idf")
    tf = spark.range(2000).selectExpr("id as rep", "1L as copies", "cast(id % 1500 as string) as term", "1L as _tf")
    found = U._with_terms(tf, idf)
    assert found.count() == tf.join(idf, "term").count()
    assert "_salt" not in found._jdf.queryExecution().toString()
