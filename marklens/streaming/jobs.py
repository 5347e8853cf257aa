"""Incremental jobs over file sources: feature extraction and duplicate arrivals.

Both give what the batch operators give on the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marklens.functions import text as X
from marklens.functions.scalars import clean_text, squeeze, text_hash

ARRIVALS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("arrived", T.TimestampType())]
)


def cleaned(docs: DataFrame) -> DataFrame:
    """Cleaned text and identity hash of every document that is not blank."""
    return docs.where(squeeze(F.col("text")) != "").select(
        "doc_id", clean_text(F.col("text")).alias("clean"), text_hash(F.col("text")).alias("text_hash")
    )


def cleaned_features(clean: DataFrame) -> DataFrame:
    """Per-document features of cleaned texts without any shuffle: counts, hash, diversity."""
    words = F.regexp_extract_all("clean", F.lit(r"\p{L}+"), F.lit(0))
    rows = clean.select(
        "doc_id", "text_hash", F.size(X.sentences(F.col("clean"))).cast("double").alias("sentence_count"), X.diversity(words).alias("_r")
    )
    n = F.col("_r.words").cast("double")
    return rows.select(
        "doc_id", "text_hash", n.alias("word_count"), "sentence_count", (n / F.col("sentence_count")).alias("mean_sentence_length"),
        F.coalesce(F.try_divide(F.col("_r.letters").cast("double"), n), F.lit(0.0)).alias("mean_word_length"),
        F.col("_r.mtld").alias("mtld"), F.col("_r.mattr").alias("mattr"),
    )


def document_features(docs: DataFrame) -> DataFrame:
    return cleaned_features(cleaned(docs))


def read_arrivals(spark: SparkSession, path: str, files_per_batch: int = 1000, schema: T.StructType = ARRIVALS) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def feature_stream(arrivals: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Features of new files, one folder per micro-batch.

    A batch that is run again after a failure overwrites its own folders, so every document is
    written exactly once; a restart goes on after the last committed batch.  The cleaned text is a
    table of its own: later feature sets can start from it.
    """

    def write(batch: DataFrame, number: int) -> None:
        texts = f"{checkpoint}-cleaned/batch={number}"
        cleaned(batch).write.mode("overwrite").parquet(texts)
        features = cleaned_features(batch.sparkSession.read.parquet(texts))
        features.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_features(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")


def first_arrivals(arrivals: DataFrame, delay: str = "7 days") -> DataFrame:
    """One row per document; state for a key is dropped once the watermark has passed it."""
    return arrivals.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["doc_id"])


def deduplicated_feature_stream(arrivals: DataFrame, out: str, checkpoint: str, delay: str = "7 days") -> StreamingQuery:
    return feature_stream(first_arrivals(arrivals, delay), out, checkpoint)
