"""Session helpers and the one place where intermediate tables are written."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(app: str = "marklens", cpus: int | str = "*", memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the workers this package, wherever the driver was started; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    archive = f"{tempfile.mkdtemp(prefix='package-')}/{name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join(name, os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may fall back to a
    folder of its own, because there driver and executors share one disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a shared folder; intermediate tables go there.")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dir[app]


#: Rows of one Arrow batch of texts; a batch is whole in memory on both sides of the pipe to Python.
TEXT_ROWS = 1000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches at TEXT_ROWS rows at most, so a worker's memory does not grow with the table."""
    now = int(spark.conf.get(_ROWS_KEY, "10000"))
    if not 0 < now <= TEXT_ROWS:
        spark.conf.set(_ROWS_KEY, str(TEXT_ROWS))


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and return the written table.

    Cuts the lineage and survives the loss of executors.  It is also what makes positions taken
    after a range sort stable: every later use reads the same files.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/marklens-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
