"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs.  All but the last return the columns of ``documents``, and any other columns of ``docs`` whatever their
names.  Empty tables stay empty.  Rows are kept or dropped one by one: a row that repeats, or one without id, is a row of
its own, except that near duplicates are told apart by id, so rows of one id stay or go together.  Null and empty texts
fail the quality rules; later stages, given such rows, keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklens.llm import decontaminate, jaccard, packing, quality, secrets
from marklens.llm.queries import vocabulary
from marklens.llm.tables import documents, fresh, materialise, where_computed

SMALL_IDS = 1_000_000


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio; the others go."""
    out = fresh(docs, "_verdict")
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), out=out)
    return where_computed(judged, F.col(f"{out}.kept")).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of near duplicates; documents without words or id are each their own group."""
    groups = jaccard.join(docs, k=5, percent=80)
    gone = materialise(groups.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    few = gone.limit(SMALL_IDS + 1).count() <= SMALL_IDS
    left = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    return left.select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by the kind's name and ``n_chars`` set to the new length."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequences; every id of every kept document lies in one piece."""
    return packing.pack(docs, vocabulary(), end_id=2)


STAGES = [
    ("quality rules", good_documents),
    ("n-gram jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: No SQL twin: SQL has neither the tokenizer nor the model stages; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name.replace(' ', '-')}")
    return docs
