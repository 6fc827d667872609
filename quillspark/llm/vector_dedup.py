"""Embedding near-duplicates by product quantisation with an exact rerank.

Vectors are compared by cosine inside their label.  They are scaled to length 1, so a cosine of
c is a distance of sqrt(2 - 2c).

* *Coarse lists.*  k-means centroids are fitted on a bounded sample (``TRAIN_ROWS`` vectors, the
  lowest hashes of their ids).  Every vector is kept in the list of its nearest centroid.
* *Probes.*  If y is within r of x, the centroid nearest to y is at most 2r further from x than
  x's own nearest centroid (triangle inequality, twice).  All those lists are probed, so
  probing loses no link.
* *Codes.*  The residual to the list's centroid is cut into subspaces; each is stored as the
  index of the nearest codeword.  A query's distance to a coded vector is a sum of entries of a
  table made once for the query (asymmetric distance).  The code's own error e is stored too:
  a vector whose table distance exceeds r + e can't be within r, all others are compared
  exactly in double precision.
* *Hot lists.*  A list is cut into blocks of members, and the queries of a list into slices; a
  task gets one block and one slice.  Each task returns a count for each query and a spanning
  forest of its links, never the pairs.
* *Joins.*  Spark estimates rows by the bytes of compressed files, doesn't see that an explode of
  probes makes up to ``LISTS`` rows of one, and counts an array as one element.  So vectors,
  members and probes aren't joined by that estimate: of these joins only the sizes of the lists
  are broadcast, after they were counted.

Equal vectors of one label form one representative whose multiplicity enters the counts.
Vectors that are null, empty, zero or hold null or non-finite components, and those with a
null label, link with nothing.  Vectors of different lengths aren't compared.  Repeated ids
count as one node for components; their rows stay.  Finite vectors of any magnitude are compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.shared import bound_batches, materialize

TRAIN_ROWS, LISTS, CODEWORDS, SUBSPACES, ROUNDS = 4096, 64, 64, 8, 8
BLOCK, SLICE = 2048, 4096
#: A table of so many lists at most is sent to every task; a longer one is joined by shuffles.
SENT_LISTS = 50_000


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's method from evenly spaced rows; an empty cluster keeps its centre."""
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


class Quantiser:
    """Coarse centroids and, for the residuals, one codebook for each subspace."""

    def __init__(self, sample: np.ndarray, lists: int = LISTS, codewords: int = CODEWORDS, subspaces: int = SUBSPACES):
        self.coarse = kmeans(sample, lists)
        residual = sample - self.coarse[self.nearest(sample)]
        self.cuts = [x for x in np.array_split(np.arange(sample.shape[1]), subspaces) if len(x)]
        self.books = [kmeans(residual[:, cut], codewords) for cut in self.cuts]

    def distances(self, x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(1)[:, None] + (self.coarse * self.coarse).sum(1)[None, :] - 2 * x @ self.coarse.T
        return np.sqrt(np.maximum(d, 0))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin(self.distances(x), axis=1)

    def encode(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the distance of each vector from its decoded form."""
        residual = x - self.coarse[near]
        codes, error = np.zeros((len(x), len(self.cuts)), dtype=np.uint8), np.zeros(len(x))
        for s, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = residual[:, cut]
            codes[:, s] = np.argmin((book * book).sum(1)[None, :] - 2 * part @ book.T, axis=1)
            error += ((part - book[codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def tables(self, q: np.ndarray, of_list: int) -> list[np.ndarray]:
        """Squared distances of each query's residual parts to all codewords."""
        residual = q - self.coarse[of_list]
        return [((residual[:, None, cut] - book[None, :, :]) ** 2).sum(2) for cut, book in zip(self.cuts, self.books, strict=True)]


def search(quantiser: Quantiser, of_list: int, q: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) of one list whose cosine is at least the given one."""
    radius = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    found = []
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        d = np.zeros((len(part), len(x)))
        for s, table in enumerate(quantiser.tables(part, of_list)):
            d += table[:, codes[:, s]]
        i, j = np.nonzero(np.sqrt(d) <= radius + error[None, :] + 1e-7)
        for lo in range(0, len(i), 200_000):
            a, b = i[lo : lo + 200_000], j[lo : lo + 200_000]
            near = np.einsum("ij,ij->i", part[a], x[b]) >= cosine
            found.append(np.stack((a[near] + at, b[near])))
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _assign(quantisers, cosine: float):
    """Each vector's list, codes and the lists that it has to probe."""

    def run(frames):
        radius = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
        for f in frames:
            for dim, part in f.groupby(f["v"].map(len)):
                z, x = quantisers.get(dim), np.stack(part["v"].to_numpy())
                d = z.distances(x)
                near = np.argmin(d, axis=1)
                codes, error = z.encode(x, near)
                probes = d <= d.min(axis=1, keepdims=True) + 2 * radius
                yield pd.DataFrame(
                    {
                        "rep": part["rep"].to_numpy(),
                        "label": part["label"].to_numpy(),
                        "times": part["times"].to_numpy(),
                        "dim": dim,
                        "list": near,
                        "probes": [np.flatnonzero(p).astype(np.int32) for p in probes],
                        "code": [c.tobytes() for c in codes],
                        "error": error,
                        "v": part["v"].to_numpy(),
                    }
                )

    return run


def _compare(quantisers, cosine: float):
    def run(f):
        z, of_list = quantisers[int(f["dim"].iloc[0])], int(f["list"].iloc[0])
        base, query = f[f["role"] == 0], f[f["role"] == 1]
        out = {"rep": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)}
        if len(base) and len(query):
            x, q = np.stack(base["v"].to_numpy()), np.stack(query["v"].to_numpy())
            codes = np.frombuffer(b"".join(base["code"]), dtype=np.uint8).reshape(len(base), -1)
            i, j = search(z, of_list, q, x, codes, base["error"].to_numpy(), cosine)
            ids, others, times = query["rep"].to_numpy(), base["rep"].to_numpy(), base["times"].to_numpy()
            apart = ids[i] != others[j]
            i, j = i[apart], j[apart]
            count = np.zeros(len(query), np.int64)
            np.add.at(count, i, times[j])
            nodes, roots = forest(ids[i], others[j])
            out = {
                "rep": np.concatenate((ids[count > 0], nodes[nodes != roots])),
                "other": np.concatenate((ids[count > 0], roots[nodes != roots])),
                "links": np.concatenate((count[count > 0], np.zeros(int((nodes != roots).sum()), np.int64))),
            }
        return pd.DataFrame(out)

    from quillspark.llm.textkit import forest

    return run


def _train(reps: DataFrame, rows: int) -> np.ndarray:
    """The vectors of the lowest hashes; a task sends no vector to the driver that isn't among them."""
    hashed = reps.select(F.xxhash64("rep").alias("h"), "v")
    lowest = hashed.select("h").orderBy("h").limit(rows).collect()
    kept = hashed.where(F.col("h") <= lowest[-1]["h"]).orderBy("h").limit(rows).select("v").collect()
    return np.array([x["v"] for x in kept])


def list_sizes(coded: DataFrame) -> DataFrame:
    """(label, dim, list, blocks, slices) of each list that has members; a vector probes its own list too."""
    asked = coded.select("label", "dim", F.col("list").alias("own"), F.explode("probes").alias("list"))
    sizes = asked.groupBy("label", "dim", "list").agg(
        F.ceil(F.count_if(F.col("own") == F.col("list")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / SLICE).cast("int").alias("slices")
    )
    return materialize(sizes.where("blocks > 0"), "sizes")


def dealt(coded: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members (role 0) and queries (role 1) of every list, one row for each block and slice they meet in."""
    key = ["label", "dim", "list"]
    sizes = F.broadcast(sizes) if sizes.count() <= SENT_LISTS else sizes.hint("merge")
    asked = coded.select("rep", "label", "dim", "v", F.explode("probes").alias("list"))
    base = coded.join(sizes, key).select(*key, F.pmod(F.hash("rep"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "rep", "times", "code", "error", "v", F.lit(0).alias("role"))
    query = asked.join(sizes, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.hash("rep"), "slices").alias("slice"), "rep", F.lit(0).cast("long").alias("times"), F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("error"), "v", F.lit(1).alias("role"))
    return base.unionByName(query)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row; links are cosines of at least ``cosine``."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e"), F.col(label_col).alias("label"))
    # Components so large or small that their squares leave the range of doubles are scaled first.
    most = F.array_max(F.transform("e", lambda x: F.abs(x)))
    scaled = F.when(F.col("most").between(1e-100, 1e100), F.col("e")).otherwise(F.transform("e", lambda x: x / F.col("most")))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    sound = F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    good = rows.where(sound & F.col("label").isNotNull() & F.col("id").isNotNull()).withColumn("most", most).where("most > 0")
    good = good.withColumn("s", scaled).withColumn("norm", norm)
    # Equal vectors share a group: their text form, hashed with 256 bits, is the key.
    keyed = good.select("id", "label", F.sha2(F.to_json(F.struct("e")), 256).alias("same"), F.transform("s", lambda x: x / F.col("norm")).alias("v"))
    groups = keyed.groupBy("label", "same").agg(F.min("id").alias("rep"), F.count("*").alias("times"))
    member = materialize(keyed.select("id", "label", "same").join(groups.hint("merge"), ["label", "same"]).select("id", "rep", "times"), "members")
    reps = keyed.join(groups.hint("merge"), ["label", "same"]).where("id = rep").dropDuplicates(["label", "same"]).select("rep", "label", "times", "v")
    reps = materialize(reps, "representatives")

    quantisers = {}
    for row in reps.groupBy(F.size("v").alias("dim")).count().collect():  # as many rows as lengths
        quantisers[row["dim"]] = Quantiser(_train(reps.where(F.size("v") == row["dim"]), train_rows))

    coded = materialize(
        reps.mapInPandas(_assign(quantisers, cosine), "rep long, label " + reps.schema["label"].dataType.simpleString() + ", times long, dim int, list int, probes array<int>, code binary, error double, v array<double>"),
        "coded",
    )
    pairs = dealt(coded, list_sizes(coded)).groupBy("label", "dim", "list", "block", "slice")
    found = pairs.applyInPandas(_compare(quantisers, cosine), "rep long, other long, links long")
    found = materialize(found, "found")
    counts = found.where("rep = other").groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(found.where("rep <> other").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    info = member.join(counts.hint("merge"), "rep", "left").join(named.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    info = info.groupBy("id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = rows.select("id").join(info, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """All embeddings, cosine 0.98 or more inside a label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm
  FROM (SELECT vec_id, label, embedding, CASE WHEN most BETWEEN 1e-100 AND 1e100 OR most = 0 THEN embedding::DOUBLE[] ELSE list_transform(embedding::DOUBLE[], lambda x: x / most) END AS e
        FROM (SELECT *, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS most FROM embeddings))
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v
  FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION
  SELECT r.node, l.v FROM reach r JOIN links l ON r.other = l.u),
component AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, k.component_id, e.vec_id = k.component_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.u = e.vec_id LEFT JOIN component k ON k.node = e.vec_id
"""
