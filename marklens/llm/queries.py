"""The registered queries of this package: each applies its operator to its whole table and derives the digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklens.llm.tables import documents

QUERIES: dict = {}
TWINS: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> str:
    """The public vocabulary file that the queries tokenize with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marklens.llm.packing import pack

    pieces = pack(documents(spark, sf_dir), vocabulary(), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marklens.llm.quality import judge

    out = judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "verdict.*")


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marklens.llm.jaccard import join

    return join(documents(spark, sf_dir), k=5, percent=80)


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marklens.llm.decontaminate import matches

    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _span_digests(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans as text."""
    base = F.filter("found", lambda s: s["kind"].isin(*kinds))

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


@query
def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marklens.llm import secrets

    return _span_digests(secrets.scan(documents(spark, sf_dir)), secrets.BASE)


TWINS["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g FROM cut
), classes AS (
  SELECT doc_id, len(g) AS n, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY len(g), md5(array_to_string(g, chr(10)))) END AS class_id, g FROM sets
), x AS (SELECT doc_id, n, unnest(g) AS h FROM classes WHERE doc_id = class_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (na + nb - c) UNION ALL SELECT b, a FROM pairs WHERE 100 * c >= 80 * (na + nb - c)
), reach AS (SELECT class_id AS node, class_id AS seen FROM classes UNION SELECT l.b, r.seen FROM reach r JOIN links l ON l.a = r.node
), least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, class_id, component_id FROM classes JOIN least ON node = class_id
"""


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marklens.llm.katz import score

    return score(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


@query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marklens.llm.suffixes import deduplicate

    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = deduplicate(documents(spark, sf_dir), length=400)
    return out.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: What conversation -1 says in both turns: the template's own marks.
_MARKS = "<|im_end|><|im_start|>assistant ok"


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marklens.llm import chat

    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    own = own.select(F.lit(-1).cast("long").alias("conv_id"), "t.turn", "t.role", F.lit(_MARKS).alias("text"))
    back = chat.read_back(chat.windows(given.union(own)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = back.select("conv_id", F.struct("window", said.alias("said"), F.array_join("targets", "").alias("loss")).alias("w"), F.size("turns").alias("n"), "chars")
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"))
    loss = F.array_join(F.col("w")["loss"], "")
    return out.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("w")["said"], ""), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


TWINS["op5_chat_formatting"] = rf"""
WITH given AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_MARKS}' UNION ALL SELECT -1, 1, 'assistant', '{_MARKS}'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM given
), counted AS (
  SELECT *, place = 1 AND role = 'system' AS sys,
         CASE WHEN place = 1 AND role = 'system' THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 END AS tokens,
         length('<|im_start|>') + length('<|im_end|>') + 2 + length(regexp_replace(role, '<(&*)\|', '<&\1|', 'g')) + length(regexp_replace(text, '<(&*)\|', '<&\1|', 'g')) AS chars
  FROM placed
), summed AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM counted
), spans AS (
  SELECT conv_id, CAST(floor(ahead / 512) AS BIGINT) AS win, min(CASE WHEN NOT sys THEN ahead END) AS start FROM summed GROUP BY ALL
), again AS (
  SELECT t.conv_id, sum(t.chars) AS chars FROM summed t JOIN spans s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
  WHERE (t.sys AND s.win > 0) OR (NOT t.sys AND s.win > floor(t.ahead / 512) AND s.start - t.ahead <= 128) GROUP BY ALL
), whole AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars) AS chars
  FROM summed GROUP BY conv_id
)
SELECT w.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (w.chars + coalesce(a.chars, 0))::BIGINT AS formatted_chars
FROM whole w LEFT JOIN again a ON w.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@query
def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marklens.llm.licenses import scan

    return scan(documents(spark, sf_dir))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marklens.llm import pii

    return _span_digests(pii.scan(documents(spark, sf_dir)), pii.BASE)


@query
def op11_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marklens.llm import warc

    return warc.archive_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


TWINS["op11_warc_packages"] = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS first FROM p),
t AS (SELECT *, n >= 1000 AND first IS NOT NULL AND (page_id IS NULL OR page_id < first) AS again FROM g)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to, url FROM t
"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings whose entries are all finite, as whole numbers ``x``."""
    from marklens.llm import vectors

    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return given.where(vectors.finite("embedding")).select("vec_id", "label", vectors.whole_numbers("embedding").alias("x"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marklens.llm import negatives

    rows = _vectors(spark, sf_dir).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, "vec_id", positives=5, negatives=10, low=30, high=90)


TWINS["op12_hard_negatives"] = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))), true)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same AND other <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marklens.llm import whitening

    return whitening.whiten(_vectors(spark, sf_dir), "vec_id", components=4).withColumnRenamed("id", "vec_id")
