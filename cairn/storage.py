"""Tables written to the folder that all executors share, and size-checked broadcasts.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: a lost executor loses nothing, since a later
read goes to the shared store. A machine-local folder is used in local mode alone.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cached_property

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast if its rows are known to take no more than this.
BROADCAST_BYTES = 24 << 20

#: Whether Spark removes an execution's shuffle files as soon as it ends, instead of when the driver's collector finds
#: that nothing refers to them.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, of ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder in local mode, as in tests; on a cluster an error, since each executor
    would write to its own disk and rows would be missing without a word.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        folder = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _fallback[app] = f"file://{folder}"
    return _fallback[app]


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cairn-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in this application's part of the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Removes all that this application has stored: to be called once its results are written or read to the end."""
    remove(spark, _own(spark))


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


#: Schemes of Spark's file systems and the names that pyarrow gives the same stores; fixed values.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs"}


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system and path of a folder or object that Spark names by ``uri``, for reads and writes in tasks.

    A Databricks path is its mount below /dbfs; a path without a scheme is local.
    """
    scheme, colon, rest = uri.partition(":")
    if scheme == "dbfs" and colon:
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if colon and "/" not in scheme:
        return fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}:{rest}")
    return fs.LocalFileSystem(), uri


def stored_bytes(spark: SparkSession, path: str) -> int:
    at, store = _path(spark, path)
    return store.getContentSummary(at).getLength()


def remove(spark: SparkSession, path: str) -> None:
    at, store = _path(spark, path)
    store.delete(at, True)


class Stored:
    """A written table: its path, and a frame that reads it."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    @cached_property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def remove(self) -> None:
        remove(self.spark, self.path)


def write(df: DataFrame, path: str, *partition_by: str) -> None:
    """Writes ``df`` as Parquet; the shuffles that made it leave the executors' disks with it.

    Later reads go to the table alone, so that disks hold the shuffles of one step, not those of all steps.
    """
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=list(partition_by) or None)
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)


def store(df: DataFrame, name: str) -> Stored:
    """Writes ``df`` to the shared folder. Who has read it to the end may ``remove()`` it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    write(df, path)
    return Stored(spark, path, df.schema)


def broadcast_if_small(df: DataFrame, n_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast only where the measured size is within ``limit``; else Spark shuffles both sides."""
    return F.broadcast(df) if n_bytes <= limit else df
