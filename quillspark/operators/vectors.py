"""A vector index on files: coarse lists as partitions, and exact nearest neighbours from as few lists as prove them.

``build`` picks centres (a bounded sample, refined by a few rounds over that sample), gives every vector to the centre with
the largest cosine and writes them, of length 1, into one folder per list.  With each list its reach is kept: the largest
angle between its centre and one of its vectors.

For a query, a list whose centre is at angle a and whose reach is r holds nothing nearer than a - r.  Lists are read in the
order of that bound, a few more each time, until the k-th best found is better than every unread list's bound: then the
result is exact.  What is read is chosen by partition folders; only k rows a round and the table of lists, whose number
grows with the root of the number of vectors, reach the driver.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import search as se
from quillspark.operators.lineage import shared_folder
from quillspark.operators.stored import Folder

SAMPLE, ROUNDS, MOST_LISTS = 20_000, 5, 4096
STATISTICS = "lists.json"
#: Angles are computed in doubles; a bound has to be beaten by more than their error.
SLACK = 1e-7


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centres by rounds of cosine means; an empty one keeps its place."""
    found = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.argmax(sample @ found.T, axis=1)
        total = np.zeros_like(found)
        np.add.at(total, own, sample)
        filled = np.linalg.norm(total, axis=1) > 1e-9
        found[filled] = unit(total[filled])
    return found


class VectorIndex:
    """An index that stands in a folder: key, unit vectors by list, centres and reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        known = json.loads(Folder(spark, folder).read(STATISTICS))
        self.key, self.kind, self.dims = known["key"], known["kind"], known["dims"]
        self.lists, self.centres, self.reach = np.array(known["lists"]), np.array(known["centres"], float).reshape(len(known["lists"]), known["dims"]), np.array(known["reach"])

    def rows(self, lists) -> DataFrame:
        paths = [f"{self.folder}/vectors/list={i}" for i in lists]
        schema = f"`{self.key}` {self.kind}, unit array<double>, list int"
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/vectors").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def nearest(self, vector, k: int = 10) -> tuple[DataFrame, int]:
        """((key, score, rank) of the k largest cosines, ties by key; the number of lists read)."""
        q = np.asarray(vector, np.float64)
        if len(q) != self.dims or not np.isfinite(q).all() or not np.linalg.norm(q) > 0:
            raise ValueError(f"a query needs {self.dims} finite components, not all 0")
        q = q / np.linalg.norm(q)
        angle = np.arccos(np.clip(self.centres @ q, -1, 1))
        bound = np.maximum(angle - self.reach, 0)
        order = np.lexsort((angle, bound))
        score = F.aggregate(F.zip_with("unit", F.lit(q.tolist()), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        # Every round reads new lists alone; the k best so far go along as a few driver rows.
        best: list[tuple] = []
        read, step = 0, max(1, math.isqrt(len(order)) // 4)
        while read < len(order):
            if len(best) == k and bound[order[read]] > math.acos(min(1.0, best[-1][1])) + SLACK:
                break
            some = self.rows([int(self.lists[i]) for i in order[read : read + step]])
            new = some.select(self.key, score.alias("score")).orderBy(F.col("score").desc(), self.key).limit(k).collect()
            best = sorted([*best, *map(tuple, new)], key=lambda r: (-r[1], r[0]))[:k]
            read, step = min(read + step, len(order)), step * 2
        schema = f"`{self.key}` {self.kind}, score double, rank int"
        return self.spark.createDataFrame([(*r, i + 1) for i, r in enumerate(best)], schema), read


def _assign(found: np.ndarray, kind: str):
    def run(frames):
        for frame in frames:
            if len(frame):
                x = unit(np.stack(frame["v"].to_numpy()).astype(np.float64))
                cos = x @ found.T
                own = cos.argmax(axis=1)
                yield pd.DataFrame({"k": frame["k"], "unit": list(x), "angle": np.arccos(np.clip(cos[np.arange(len(x)), own], -1, 1)), "list": own.astype(np.int32)})

    return run


def build(rows: DataFrame, folder: str, key: str = "vec_id", vector_col: str = "embedding", lists: int | None = None) -> VectorIndex:
    """Write the index of all vectors of the most usual length that are finite and not zero; others are never near anything.

    The number of lists grows with the root of the number of vectors, up to MOST_LISTS, so that their centres stay small.
    A list with more rows than others is written by several tasks.
    """
    spark = rows.sparkSession
    v = F.col(vector_col).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & F.exists("v", lambda x: F.abs(x) > 1e-150)
    known = rows.select(F.col(key).alias("k"), v.alias("v")).where(F.coalesce(good, F.lit(False)))
    dims = known.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    dims, n = (dims["d"], dims["count"]) if dims else (0, 0)
    known = known.where(F.size("v") == dims)
    sample = known.orderBy(F.xxhash64("k"), "k").limit(SAMPLE).select("v").collect() if n else []
    lists = min(lists or max(1, math.isqrt(n)), MOST_LISTS, max(1, len(sample)))
    found = centres(unit(np.array([r["v"] for r in sample])), lists) if n else np.zeros((0, 0))
    kind = rows.schema[key].dataType.simpleString()
    dealt = known.mapInPandas(_assign(found, kind), f"k {kind}, unit array<double>, angle double, list int").withColumnRenamed("k", key)
    parts = max(1, min(lists, 4 * spark.sparkContext.defaultParallelism))
    dealt.repartition(parts, "list", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("list").parquet(f"{folder}/vectors")
    written = spark.read.schema(dealt.schema).parquet(f"{folder}/vectors")
    reach = sorted((r["list"], r["reach"]) for r in written.groupBy("list").agg(F.max("angle").alias("reach")).collect())  # a row a list
    state = {"key": key, "kind": kind, "dims": dims, "lists": [i for i, _ in reach], "centres": [found[i].tolist() for i, _ in reach], "reach": [r for _, r in reach]}
    Folder(spark, folder).create(STATISTICS, json.dumps(state))
    return VectorIndex(spark, folder)


def ensure(spark: SparkSession, path: str, key: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
    """The index of a Parquet table in the shared folder, built the first time and when its files have changed."""
    import hashlib
    import uuid

    from quillspark.operators.postings import fingerprint

    name = hashlib.sha256(repr((fingerprint(spark, path), key, vector_col)).encode()).hexdigest()[:16]
    base = f"{shared_folder(spark)}/quillspark-vectors"
    for n in Folder(spark, base).names():
        if n.startswith(f"{name}-") and Folder(spark, f"{base}/{n}").names(STATISTICS):
            return VectorIndex(spark, f"{base}/{n}")
    return build(spark.read.parquet(path), f"{base}/{name}-{uuid.uuid4().hex[:8]}", key, vector_col)


def semantic(index: VectorIndex, vector, k: int = 10, threshold: float = -1.0) -> DataFrame:
    """(key, score, rank): ``search.semantic``'s first page without the number of all hits."""
    se.check_parameters(threshold, -1.0, 1.0, limit=k)
    found, _ = index.nearest(vector, k)
    return found.where(F.col("score") >= threshold)
