"""Scratch tables in the folder that the driver and all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Where that setting is absent, a session on
one machine (tests) makes a temporary folder; on a cluster that is an error.  A scratch table cuts lineage:
it survives the loss of executors, as the shared store keeps its files.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quillspark.functions.arrow import bound_batches  # noqa: F401  for the operators

#: While a scratch table is written: its shuffle files go as soon as it stands.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FALLBACK: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []
_SCOPES: list[list["Table"]] = []


def scratch_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="quillspark-")
    return "file://" + _FALLBACK["dir"]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system."""
    jvm, jsc = spark._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


class Table:
    """A DataFrame written to the shared folder and read again."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/quillspark/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "snappy").parquet(self.path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _MADE.append((self.spark, self.path))
        if _SCOPES:
            _SCOPES[-1].append(self)

    def drop(self) -> None:
        remove(self.spark, self.path)


@contextmanager
def recording(tables: list[Table]):
    """Scratch tables made inside are added to a list, so that they can be dropped in time."""
    _SCOPES.append(tables)
    try:
        yield
    finally:
        _SCOPES.pop()


def materialize(df: DataFrame, name: str) -> DataFrame:
    return Table(df, name).df


def free(spark: SparkSession) -> None:
    """Let the driver drop what it no longer refers to, so that Spark's cleaner removes old shuffle files.

    The cleaner follows the driver's garbage collection, which a small plan hardly triggers.
    """
    gc.collect()
    spark._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
