"""Centroid clustering: plain Lloyd rounds in exact integers.

A vector counts if it has exactly ``dims`` components, none null, NaN or infinite; others are left out.  A component x
becomes the integer floor(256 * x), held to 28 bits so that every squared distance fits a long (|x| over 524,288 counts
as that).  Only ``k`` centroids and, for each, one row of sums ever reach the driver; vectors stay where they are read.
Every round reads the table again, one column wide, so nothing is stored but the last assignment (20 bytes a vector).

Rows of a repeated id are separate vectors; null ids stay null and sort after all others as first centroids; equal
hashes go by the vector's components.  With fewer than ``k`` vectors each starts a centroid; without any the result is
empty.  Other columns of the table are never looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import materialize

SCALE, DIMS, CENTROIDS, ROUNDS, SEED = 256.0, 64, 40, 5, "2:"
MOST, LONG_MAX = 1 << 27, (1 << 63) - 1


def usable(vector: Column, dims: int) -> Column:
    """The vector has ``dims`` finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def integers(vectors) -> np.ndarray:
    """One row of integers for each vector of a pandas column."""
    x = np.concatenate(vectors.to_numpy()).astype(np.float64).reshape(len(vectors), -1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -MOST, MOST).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; of equal ones the lowest number."""
    away = np.empty((len(centroids), len(x)), np.int64)
    for number, centroid in enumerate(centroids):
        d = x - centroid
        away[number] = np.einsum("ij,ij->i", d, d)
    best = away.argmin(axis=0)
    return best, away[best, np.arange(len(x))]


def _sums(centroids: np.ndarray):
    """A partition's count and componentwise sum of each cluster, as k rows at most."""
    k, dims = centroids.shape

    def run(frames):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for frame in frames:
            if len(frame):
                x = integers(frame["vector"])
                best, _ = nearest(x, centroids)
                count += np.bincount(best, minlength=k)
                np.add.at(total, best, x)
        own = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": own.astype(np.int32), "n": count[own]} | {f"s{i}": total[own, i] for i in range(dims)})

    return run


def _assign(centroids: np.ndarray):
    def run(frames):
        for frame in frames:
            if len(frame):
                best, away = nearest(integers(frame["vector"]), centroids)
                yield pd.DataFrame({"id": frame["id"], "cluster": best.astype(np.int32), "distance": away})

    return run


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed and id: a partial top k in each partition."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    rows = vectors.select(digest.alias("digest"), "vector").orderBy(F.col("digest").asc_nulls_last(), "vector").limit(k).collect()
    return integers(pd.Series([np.array(r["vector"]) for r in rows])) if rows else np.zeros((0, 0), np.int64)


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the clusters; a centroid without vectors stays."""
    dims = centroids.shape[1]
    schema = "cluster int, n long, " + ", ".join(f"s{i} long" for i in range(dims))
    parts = vectors.select("vector").mapInPandas(_sums(centroids), schema)
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(exact("n"), *[exact(f"s{i}") for i in range(dims)]).collect():  # k rows
        out[row["cluster"]] = [int(row[f"s{i}"]) // int(row["n"]) for i in range(dims)]
    return out


def lloyd(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) for each vector that counts, the final centroids)."""
    kind = "array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    vectors = vectors.where(usable(F.col("vector"), dims))
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], "id long, cluster int, distance long").withColumnRenamed("id", id_col), centroids
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)
    return vectors.mapInPandas(_assign(centroids), "id long, cluster int, distance long").withColumnRenamed("id", id_col), centroids


def _fits(total: Column) -> Column:
    return F.least(total, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def with_inertia(assigned: DataFrame, centroids: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    """Assignments with their cluster's and all clusters' sum of distances (at most the largest long) and the centroid's digest."""
    out = materialize(assigned, "centroids")
    spark: SparkSession = out.sparkSession
    per = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast("decimal(38,0)").alias("own"))
    sums = {r["cluster"]: int(r["own"]) for r in per.collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = [(i, min(sums[i], LONG_MAX), min(sum(sums.values()), LONG_MAX), digests[i]) for i in sums]
    table = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(table), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """Clusters of all vectors."""
    assigned, centroids = lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_inertia(assigned, centroids)


def _round(i: int) -> str:
    """SQL of one round: distances to the centroids c{i}, assignment a{i}, means c{i + 1}."""
    assign = f"""
a{i} AS MATERIALIZED (SELECT rid, arg_min(cluster, away * {CENTROIDS} + cluster) AS cluster, min(away) AS distance FROM (
  SELECT v.rid, c.cluster, sum((v.x - c.x) * (v.x - c.x))::HUGEINT AS away FROM v JOIN c{i} c USING (d) GROUP BY v.rid, c.cluster) GROUP BY rid)"""
    if i == ROUNDS:
        return assign
    return f"""{assign},
c{i + 1} AS MATERIALIZED (SELECT c.cluster, c.d, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x)::BIGINT AS x FROM c{i} c LEFT JOIN (
  SELECT a.cluster, v.d, sum(v.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} a JOIN v USING (rid) GROUP BY a.cluster, v.d) m USING (cluster, d))"""


ORACLE = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
v AS MATERIALIZED (SELECT rid, d, floor({SCALE}::DOUBLE * embedding[d]::DOUBLE)::BIGINT AS x FROM k, (SELECT unnest(range(1, {DIMS + 1})) AS d)),
s AS (SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}' || vec_id), embedding) - 1 AS cluster FROM k QUALIFY cluster < {CENTROIDS}),
c0 AS MATERIALIZED (SELECT s.cluster, v.d, v.x FROM s JOIN v USING (rid)),{",".join(_round(i) for i in range(ROUNDS + 1))},
h AS (SELECT cluster, sha256(string_agg(x, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT k.vec_id, a.cluster::INTEGER AS cluster, a.distance::BIGINT AS distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(a.distance) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM k JOIN a{ROUNDS} a USING (rid) JOIN h ON h.cluster = a.cluster"""
