"""Readers and writers with explicit schemas; no inference, no full-table driver reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marklens.session import materialise

from marklens.operators.contracts import ContractError

# Fixed names: what partition arguments may be called.
PARTITIONS = {
    "train": "model_train", "model_train": "model_train", "val": "validation", "validation": "validation",
    "test": "official_test", "official_test": "official_test", "all": None,
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, rename: Mapping[str, str] | None = None) -> DataFrame:
    """CSV with a declared schema and raw names mapped to canonical ones; a malformed row fails the job."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    return df.withColumnsRenamed(dict(rename)) if rename else df


def read_partition(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One named partition of a table partitioned by ``split``; unknown names are refused."""
    if name not in PARTITIONS:
        raise ContractError(f"unknown partition {name!r}; expected one of {sorted(PARTITIONS)}")
    df = spark.read.parquet(path)
    wanted = PARTITIONS[name]
    return df if wanted is None else df.where(F.col("split") == wanted)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str], deny: Sequence[str] = ()) -> DataFrame:
    """Only the asked columns reach the scan; denied ones can not be asked for."""
    blocked = sorted(set(columns) & set(deny))
    if blocked:
        raise ContractError(f"columns must not be read: {blocked}")
    return spark.read.parquet(path).select(*columns)


def allow_listed(rows: DataFrame, allowed: DataFrame, key: str, forbidden: DataFrame | None = None) -> DataFrame:
    """Rows whose key is allowed; overlap of allowed and forbidden keys is an error."""
    if forbidden is not None and not allowed.join(forbidden, key, "left_semi").isEmpty():
        raise ContractError("an allowed key is also forbidden")
    return rows.join(allowed.select(key).distinct(), key, "left_semi")


def write_corpus(sources: Mapping[str, DataFrame], manifest: DataFrame, key: str, path: str, columns: Sequence[str]) -> None:
    """Union the sources, attach the manifest, and write one table partitioned by ``split``."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("source_partition", F.lit(name))
        out = part if out is None else out.unionByName(part)
    out.join(manifest, key).select(*columns, "source_partition", "split").write.mode("overwrite").partitionBy("split").parquet(path)


def twelve_digits(x: str):
    """Twelve significant digits as text, as C's ``%.12g`` writes them.

    The rounded exponent decides the form: fixed notation from 1e-5 (excluded) to 1e12, exponent notation outside;
    trailing zeros are cut in both.  Subnormal numbers have fewer digits than asked for and are written with those.
    """
    v = F.col(x).cast("double")
    written = F.format_string("%.11e", F.abs(v))
    exponent = F.regexp_extract(written, r"e([+-]\d+)$", 1).try_cast("int")
    digits = F.concat(F.substring(written, 1, 1), F.substring(written, 3, 11))
    cut = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")
    whole = F.concat(F.left(digits, exponent + 1), F.lit("."), F.right(digits, 11 - exponent))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    form = F.when((exponent < -4) | (exponent > 11), cut(written)).when(exponent >= 0, cut(whole)).otherwise(cut(small))
    sign = F.when(F.signum(v) < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(F.isnan(v), F.lit("nan")).when(F.abs(v) == float("inf"), F.concat(sign, F.lit("inf"))).when(v == 0, F.lit("0")).otherwise(F.concat(sign, form))


def write_numeric_csv(df: DataFrame, path: str) -> None:
    """CSV with twelve significant digits; the commit protocol makes the job's output appear whole."""
    cols = [
        twelve_digits(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def row_digest(columns: Sequence[str]):
    """md5 of the row's texts, NULL marked apart from the empty text."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-insensitive fingerprint: rows, and the sums and xors of all four 32-bit words of the rows' digests."""
    words = df.select(row_digest(columns).alias("_h")).select(
        *[F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"_w{i}") for i in range(4)]
    )
    got = words.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(f"_w{i}").alias(f"_s{i}") for i in range(4)], *[F.bit_xor(f"_w{i}").alias(f"_x{i}") for i in range(4)])
    xor = F.concat(*[F.lower(F.lpad(F.hex(f"_x{i}"), 8, "0")) for i in range(4)])
    return got.select("rows", F.concat_ws(":", *[F.col(f"_s{i}").cast("string") for i in range(4)]).alias("digest_sum"), xor.alias("digest_xor"))


#: Ids, and digests, that one task puts in order at once, on average.
IDS_PER_BUCKET = 1024


def ordered_id_digest(df: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """SHA-256 of the ids of each group as a hash tree.

    A group's ids are cut by the first hex digits of their md5, as many as the largest group needs for buckets of
    about ``IDS_PER_BUCKET``; a bucket digests its own sorted ids, and buckets of one longer prefix are digested in
    order, two digits at a time, so no task holds more than a bucket or 256 digests.
    """
    rows = materialise(df.select(*by, F.col(key).cast("string").alias("_id")), "ids")
    most = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    digits = 0
    while most > IDS_PER_BUCKET * 16**digits:
        digits += 1
    level = rows.withColumn("_b", F.substring(F.md5(F.col("_id").cast("binary")), 1, digits)).groupBy(*by, "_b").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("_id")), "\n").cast("binary"), 256).alias("_d"), F.count(F.lit(1)).alias("ids")
    )
    while True:
        digits = max(0, digits - 2)
        pair = F.array_sort(F.collect_list(F.struct("_b", "_d")))
        level = level.groupBy(*by, F.substring("_b", 1, digits).alias("_p")).agg(
            F.sum("ids").alias("ids"), F.sha2(F.array_join(F.transform(pair, lambda p: p["_d"]), "\n").cast("binary"), 256).alias("_d")
        ).withColumnRenamed("_p", "_b")
        if not digits:
            return level.select(*by, "ids", F.col("_d").alias("digest"))


def file_bytes(spark, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file below a path; each file is digested by one task, as its digest is sequential.

    Spark's reader leaves out empty files and refuses files beyond 2 GB.
    """
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
