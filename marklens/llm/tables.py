"""Where the operators of this package keep intermediate tables, and the plain input rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklens.session import materialise  # noqa: F401  (re-used by every operator)


#: Rows of one Arrow batch of texts; a batch is whole in memory on both sides of the pipe to Python.
BATCH_ROWS = 1000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches at BATCH_ROWS rows at most; long texts would make larger ones too large."""
    now = int(spark.conf.get(_ROWS_KEY, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns that an operator needs, under its own names; a null text is an empty one."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[F.col(m) for m in more],
    )


def parallel(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it until no column has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def where_computed(df: DataFrame, condition) -> DataFrame:
    """``df.where(condition)`` above the projection that computes what the condition reads.

    Spark pushes a filter through a projection by copying expressions into it, also into the bodies of lambdas, where
    they would run once per element.  It does not push one through a projection of row numbers.
    """
    row = fresh(df, "_row")
    return df.withColumn(row, F.monotonically_increasing_id()).where(condition & (F.col(row) >= 0)).drop(row)
