"""Puts this package where Python workers can import it, and bounds what is sent to them at once."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, where the session has Spark's own default of 64 MB.
BATCH_BYTES = 8 << 20
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LIMIT, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's, else one of our own.

    Where nothing is set, a local master gets a temporary folder (as in tests), which goes when the driver ends, and
    any other master a folder in the warehouse; if that is on the driver's own disk, which executors don't see, it is an
    error.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        folder = tempfile.mkdtemp(prefix="lodeworks-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = "file://" + folder
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lodeworks"
        if _files(spark, own)[0].getUri().getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(own)
    return work_folder(spark)


def _files(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of Hadoop's."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later plan reads."""
    fs, at = _files(spark, path)
    fs.delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; what is written there goes when the driver ends."""
    path = f"{work_folder(spark)}/lodeworks/{name}-{uuid.uuid4().hex}"
    fs, at = _files(spark, path)

    def end() -> None:
        with contextlib.suppress(Py4JError, OSError):  # the JVM may have ended before
            fs.delete(at, True)

    atexit.register(end)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again: made once, however often a plan uses it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """A query's shuffle files go when it is done; otherwise they stay until the driver's heap is collected, which may be
    long after the disk is full."""
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions. Given as a number they stay: what is left to adaptive execution becomes about a
    task for each core by the bytes, and one more waits for a round of its own where rows are slim and slow to parse."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(files: DataFrame) -> DataFrame:
    """(path, content) by path, for a parser: one scan task of a small table may make very many files."""
    return files.select("path", "content").repartition(partitions(files.sparkSession), "path")


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once for each Spark context, through Spark's own file server.

    Workers hold a batch of whole texts and what is made of it, so a session with the default size of batches gets a
    smaller one; a size that was chosen stays.
    """
    sc = spark.sparkContext
    if spark.conf.get(_LIMIT, _DEFAULT).rstrip("b") == _DEFAULT:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    if getattr(sc, "_lodeworks_shipped", False):
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="lodeworks-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    atexit.register(Path(name).unlink, missing_ok=True)
    sc._lodeworks_shipped = True
