"""Session, table reading and shared storage; nothing here looks at data."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent


def session(app: str = "sessionlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine assumes: UTC, AQE, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of an input folder, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_sessionlake_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="sessionlake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "sessionlake_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(archive)
    context._sessionlake_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, in tests on one machine, it is a folder of our own; elsewhere that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(context, "_sessionlake_shared", None):
        context._sessionlake_shared = tempfile.mkdtemp(prefix="sessionlake-shared-")
        atexit.register(shutil.rmtree, context._sessionlake_shared, ignore_errors=True)
    return context._sessionlake_shared


def fingerprint(spark: SparkSession, path: str) -> str:
    """A name for what a file or folder holds now: its files with their lengths and times."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while files.hasNext():
        status = files.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:32]


def _written(spark: SparkSession) -> list[str]:
    """The paths that materialize() wrote in this context and nobody deleted, in order."""
    context = spark.sparkContext
    if not hasattr(context, "_sessionlake_written"):
        context._sessionlake_written = []
    return context._sessionlake_written


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and lost executors cost no more than it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written(spark).append(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def few(df: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A written table for a join: marked for a broadcast if it has at most so many rows, which should be narrow; else as it is, and the join shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written(spark):
        _written(spark).remove(path)


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    _delete(df.sparkSession, df._written_to)


def mark(spark: SparkSession) -> int:
    """A place for discard_since()."""
    return len(_written(spark))


def discard_since(spark: SparkSession, place: int, *keep: DataFrame) -> None:
    """Delete the tables that materialize() wrote after mark(), but for some: when their reader's result is written."""
    kept = {df._written_to for df in keep}
    for path in _written(spark)[place:]:
        if path not in kept:
            _delete(spark, path)
