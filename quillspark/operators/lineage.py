"""Cutting the lineage of loops over levels, and the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without that setting a temporary one, on a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quillspark-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return "file://" + _LOCAL[0]


def settled(df: DataFrame) -> DataFrame:
    """The rows computed once: a checkpoint where the session names a folder, else kept in place.

    A checkpoint survives lost executors; what is only kept is computed again.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
