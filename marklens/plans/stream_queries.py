"""Section N: streaming jobs run to completion over files of documents, and the tokenizer table function."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marklens.functions import scalars as S
from marklens.functions import text as X
from marklens.plans.registry import query
from marklens.plans.text_queries import _MTLD, _mattr
from marklens.plans.text_views import with_text
from marklens.plans.sqltext import r, rounded
from marklens.plans.views import table, texts
from marklens.session import scratch_dir, small_batches
from marklens.streaming import jobs as N

c = F.col


def _arrivals(spark, sf, repeat: bool):
    """Documents as arriving files; with ``repeat``, the German ones arrive a second time."""
    base = f"{scratch_dir(spark)}/marklens-arrivals-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", F.timestamp_seconds(c("doc_id") % 86400 + F.lit(1_700_000_000)).alias("arrived"), "lang"
    )
    files = max(4, docs.rdd.getNumPartitions())  # as many as the table has splits, so no task grows with it
    docs.drop("lang").repartition(files, "doc_id").write.mode("append").parquet(base)
    if repeat:
        docs.where("lang = 'de'").drop("lang").write.mode("append").parquet(base)
    return base, files // 2


def _run(spark, arrivals, start):
    path, files = arrivals
    small_batches(spark)
    out, mark = f"{path}-out", f"{path}-checkpoint"
    start(N.read_arrivals(spark, path, files), out, mark).awaitTermination()
    return N.read_features(spark, out)


_SQL = with_text("tk", f"""WITH d AS (SELECT doc_id, sha256(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')) AS text_hash FROM documents), {_MTLD}, {_mattr('ma', 'is_alpha')}
SELECT tk.doc_id, any_value(text_hash) AS text_hash, count(*) FILTER (WHERE is_alpha)::DOUBLE AS word_count, count(DISTINCT sent_id)::DOUBLE AS sentence_count, {r('count(*) FILTER (WHERE is_alpha)/count(DISTINCT sent_id)', 'mean_sentence_length')},
{r('coalesce(avg(length(lemma)) FILTER (WHERE is_alpha), 0)', 'mean_word_length')}, {r('any_value(mtld)', 'mtld', 7)}, {r('coalesce(any_value(CASE WHEN ma.n>=2 THEN ma.v END), 0)', 'mattr')}
FROM tk JOIN d ON d.doc_id=tk.doc_id JOIN ml ON ml.doc_id=tk.doc_id LEFT JOIN ma ON ma.doc_id=tk.doc_id GROUP BY tk.doc_id""")


@query("n1_feature_stream", _SQL)
def _n1(spark, sf):
    arrivals = _arrivals(spark, sf, False)
    return rounded(_run(spark, arrivals, N.feature_stream).withColumn("mtld", F.round("mtld", 7)))


@query("n2_duplicate_arrivals", _SQL)
def _n2(spark, sf):
    arrivals = _arrivals(spark, sf, True)
    return rounded(_run(spark, arrivals, N.deduplicated_feature_stream).withColumn("mtld", F.round("mtld", 7)))


@query("n3_exploded_tokens", with_text("tk", "SELECT doc_id, sent_id, sent_pos, tok_i, text, is_alpha FROM tk"))
def _n3(spark, sf):
    from marklens.operators.features import token_table

    return token_table(texts(spark, sf)).drop("piece_length")
