"""Tables kept in a shared folder as snapshots: keyed upserts, safe repeats of a batch, and readers that see whole states.

A table is cut by the hash of its key into buckets, each a folder of Parquet files that never changes.  A snapshot is a
small JSON file that names every bucket's folder; it is written last, under a name that must not exist yet.  A change
writes new folders for the buckets that it touches and then the next snapshot, so

* a reader takes the newest snapshot and sees all of a change or nothing of it;
* a job that dies before the snapshot is written leaves files that nobody refers to (``clean`` removes them);
* two writers can't both write snapshot n: the second fails and may try again on the newer state;
* a snapshot remembers the last batch of each stream, and a batch that comes again changes nothing.

A change costs the buckets that it touches, not the table.  The number of buckets is fixed when a table is created.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.operators.store import upsert

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer made the next snapshot first."""


class Folder:
    """Small files of a folder through Hadoop's file system, which every Spark path has."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path.rstrip("/"), spark._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        where = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a file whole under a name that mustn't exist."""
        part = f"_new-{uuid.uuid4().hex}"
        out = self.fs.create(self._path(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(name)
        if self.fs.exists(target) or not self.fs.rename(self._path(part), target):
            self.fs.delete(self._path(part), False)
            raise Conflict(f"{self.path}/{name} exists")

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class StoredTable:
    """One table in ``<folder>``; ``create`` makes it, ``open`` finds it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Folder(spark, folder)

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: str | StructType, key: str, buckets: int = 64) -> "StoredTable":
        """The table, made empty if it isn't there; another schema, key or number of buckets is refused."""
        kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        table = cls(spark, folder)
        if not table.snapshots():
            state = {"schema": kind.json(), "key": key, "buckets": buckets, "paths": {}, "streams": {}}
            try:
                table.folder.create(table._name(0), json.dumps(state))
            except Conflict:
                pass  # made by another writer meanwhile
        state = table.state()
        if (StructType.fromJson(json.loads(state["schema"])), state["key"]) != (kind, key):
            raise TypeError(f"{folder} holds another table")
        return table

    @staticmethod
    def _name(version: int) -> str:
        return f"snapshot-{version:012d}.json"

    def snapshots(self) -> list[int]:
        return [int(n[9:21]) for n in self.folder.names() if n.startswith("snapshot-")]

    def state(self, version: int | None = None) -> dict:
        known = self.snapshots()
        if not known:
            raise FileNotFoundError(self.folder.path)
        version = known[-1] if version is None else version
        return json.loads(self.folder.read(self._name(version))) | {"version": version}

    def _rows(self, state: dict, buckets=None) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        wanted = [p for b, p in state["paths"].items() if buckets is None or int(b) in buckets]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder.path}/{p}" for p in wanted])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot, the newest by default."""
        return self._rows(self.state(version))

    def get(self, key) -> DataFrame:
        """The row of a key, from its bucket alone."""
        state = self.state()
        kind = StructType.fromJson(json.loads(state["schema"]))[state["key"]].dataType
        n = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(key).cast(kind)), F.lit(state["buckets"]))).first()[0]
        return self._rows(state, {n}).where(F.col(state["key"]) == key)

    def _write(self, rows: DataFrame, name: str, count: int) -> None:
        """Rows by bucket; a hot bucket is split over tasks by the rows' own hash."""
        spread = F.pmod(F.xxhash64(*[c for c in rows.columns if not c.startswith("_bucket") and rows.schema[c].dataType.typeName() not in ("map", "variant")]), F.lit(8))
        rows.repartition(max(1, count), F.col(BUCKET), spread).write.partitionBy(BUCKET).parquet(f"{self.folder.path}/{name}")

    def change(self, changes: DataFrame, how, stream: str | None = None, batch: int | None = None) -> int:
        """Apply ``how(rows of the touched buckets, changes)``; returns the version that holds the change.

        With a stream's name, a batch number that isn't above the last one applied changes nothing.
        """
        state = self.state()
        if stream is not None and batch <= state["streams"].get(stream, -1):
            return state["version"]
        bucket = F.pmod(F.xxhash64(F.col(state["key"])), F.lit(state["buckets"])).cast("int")
        touched = {r[0] for r in changes.select(bucket.alias("b")).distinct().collect()}  # at most the number of buckets
        paths = dict(state["paths"])
        if touched:
            name = f"data-{uuid.uuid4().hex}"
            after = how(self._rows(state, touched), changes).withColumn(BUCKET, bucket)
            self._write(after, name, min(len(touched), self.spark.sparkContext.defaultParallelism * 4))
            made = {int(n.partition("=")[2]) for n in self.folder.names(name) if n.startswith(BUCKET)}
            paths = {b: p for b, p in paths.items() if int(b) not in touched} | {str(b): f"{name}/{BUCKET}={b}" for b in made}
        after = {k: v for k, v in state.items() if k != "version"} | {"paths": paths}
        after["streams"] = state["streams"] | ({stream: batch} if stream is not None else {})
        self.folder.create(self._name(state["version"] + 1), json.dumps(after))
        return state["version"] + 1

    def upsert(self, changes: DataFrame, order: str | None = None, stream: str | None = None, batch: int | None = None) -> int:
        """Insert or replace by key; of several changes of a key the last by ``order``, by default the first other column."""
        key = self.state()["key"]
        order = order or next((c for c in changes.columns if c != key), key)
        return self.change(changes, lambda rows, new: upsert(rows, new, key, order), stream, batch)

    def delete(self, keys: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        key = self.state()["key"]
        return self.change(keys.select(key).distinct(), lambda rows, gone: rows.join(gone, key, "left_anti"), stream, batch)

    def clean(self, keep: int = 10) -> list[str]:
        """Remove snapshots but the last ``keep`` and every data folder that none of these names.  No writer may be at work."""
        known = self.snapshots()
        for v in known[:-keep]:
            self.folder.remove(self._name(v))
        used = {p.partition("/")[0] for v in known[-keep:] for p in self.state(v)["paths"].values()}
        gone = [n for n in self.folder.names() if n.startswith("data-") and n not in used]
        for n in gone:
            self.folder.remove(n)
        return gone


def upsert_stream(changes: DataFrame, table: StoredTable, checkpoint: str, name: str, order: str, every: str | None = "1 second", once: bool = False):
    """A stream writer that merges each micro-batch into a stored table; rows become visible a batch at a time.

    Spark repeats the last batch after a failure; by its number the table knows whether it is in already.
    """
    writer = changes.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda rows, batch: table.upsert(rows, order, name, batch) and None)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)

