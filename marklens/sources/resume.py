"""Resumable jobs: finished keys are taken out by an anti-join, new results are appended."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from marklens.operators.contracts import ContractError


def load_done(spark: SparkSession, path: str, schema) -> DataFrame:
    """Results so far, or an empty frame; a different schema is refused."""
    try:
        done = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    have = {(f.name, f.dataType.simpleString()) for f in done.schema.fields}
    want = {(f.name, f.dataType.simpleString()) for f in schema.fields}
    if have != want:
        raise ContractError(f"stored results have another schema: {sorted(have ^ want)}")
    return done


def pending(items: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return items.join(done.select(*keys), list(keys), "left_anti")


def run_pending(
    items: DataFrame, path: str, schema, keys: Sequence[str], work: Callable[[DataFrame], DataFrame], config: str | None = None
) -> DataFrame:
    """Do the missing items and append; with ``config``, results of another configuration do not count."""
    spark = items.sparkSession
    done = load_done(spark, path, schema)
    if config is not None:
        items = items.withColumn("config_sha", F.sha2(F.lit(config), 256))
    todo = pending(items, done, [*keys, "config_sha"] if config is not None else keys)
    result = work(todo)
    result.select(*[f.name for f in schema.fields]).write.mode("append").parquet(path)
    out = spark.read.parquet(path)
    return out.where(F.col("config_sha") == F.sha2(F.lit(config), 256)) if config is not None else out
