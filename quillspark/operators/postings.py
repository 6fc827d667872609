"""An inverted index on files, and BM25, phrase and stemmed searches that read only what the query's terms need.

``build`` writes two tables into a folder.  ``postings`` (term, key, tf, dl, positions) lies in folders by the term's hash
(``bucket``) and by how much a posting can add to a score (``band``, 0 the most); files are sorted by term, so a search
opens a few folders and skips other terms' row groups.  ``terms`` (term, df, tops) has each term's document frequency and the
largest impact in every band, ``forms`` (stem, term) the terms of each stem, both by hash.  The statistics file is written
last: an index without it isn't there.

Equal tokens of a batch of documents are counted before the shuffle, which deals postings out by groups of terms and
slices of the key: a term that stands in every document is spread over all slices.  Nothing but statistics of the query's own terms
reaches the driver.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
import zlib
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import stems, text as tx
from quillspark.operators import search as se
from quillspark.operators.lineage import shared_folder
from quillspark.operators.stored import Conflict, Folder

#: Lower bounds of the bands as shares of the largest impact a posting can have.
BANDS = (0.75, 0.5, 0.25, 0.0)
BUCKETS, SLICES, GROUPS = 16, 4, 4
#: Bytes of text whose postings a part holds, about.
PART_BYTES = 32 << 20
STATISTICS, FORMAT = "statistics.json", 5


def impact(tf: Column, dl: Column, mean: float) -> Column:
    """What a posting adds to the score for an inverse document frequency of 1; below K1 + 1."""
    return tf * (se.K1 + 1) / (tf + se.K1 * (1 - se.B + se.B * dl / F.lit(float(mean))))


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def spread(docs: DataFrame) -> DataFrame:
    """Rows over all cores where the table has fewer splits than that, as a single small file has."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _flat(column):
    """The items of all lists of a column, in one array."""
    flat = pc.list_flatten(column)
    return flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat


def _heads(*sorted_: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.zeros(len(sorted_[0]), bool)
    new[:1] = True
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _checksums(words: pa.Array) -> np.ndarray:
    """``crc32`` of each word's bytes, read where they lie."""
    if not len(words):
        return np.zeros(0, np.int64)
    _, offsets, data = words.buffers()
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    ends, view = np.frombuffer(offsets, kind)[words.offset : words.offset + len(words) + 1].tolist(), memoryview(data)
    return np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(ends, ends[1:])), np.int64, len(words))


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def counted(batch: pa.RecordBatch, slices: int, positions: bool) -> pa.RecordBatch | None:
    """The postings of a batch of rows (key, slice, tokens): a row for each part, in which a term stands once before its documents."""
    keys, sliced, tokens = (batch.column(i) for i in range(3))
    size, flat = pc.list_value_length(tokens).to_numpy().astype(np.int64), _flat(tokens)
    if not len(flat):
        return None
    coded = flat.dictionary_encode()
    words, n = coded.dictionary, len(coded.dictionary)
    at = np.repeat(np.arange(len(size)) * n, size) + coded.indices.to_numpy()
    order = np.argsort(at, kind="stable") if positions else None
    at = np.sort(at) if order is None else at[order]
    first = _heads(at)
    tf = np.diff(np.append(first, len(at)))
    row, code = at[first] // n, at[first] % n
    part = (_checksums(words) % GROUPS)[code] * slices + sliced.to_numpy()[row]
    by = np.argsort(part * n + code, kind="stable")
    part, code, row, tf, first = part[by], code[by], row[by], tf[by], first[by]
    entry, parts = _heads(part, code), _heads(part)
    lists = lambda starts, values: pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)
    columns = [
        pa.array(part[parts], pa.int32()),
        lists(np.searchsorted(entry, parts), words.take(pa.array(code[entry]))),
        lists(np.searchsorted(entry, parts), pa.array(np.diff(np.append(entry, len(code))), pa.int32())),
        lists(parts, keys.take(pa.array(row))),
        lists(parts, pa.array(tf, pa.int32())),
        lists(parts, pa.array(size[row], pa.int32())),
    ]
    if positions:
        places = (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size))[order]
        columns.append(lists((np.cumsum(tf) - tf)[parts], pa.array(_gathered(places, first, tf), pa.int32())))
    return pa.RecordBatch.from_arrays(columns, names=["part", "term", "times", "key", "tf", "dl", *(["places"] if positions else [])])


def merged(rows: pa.Table, typical: float, buckets: int, positions: bool):
    """A part's postings (term, key, tf, dl, positions, bucket, band) by bucket, band and term, in batches."""
    coded = _flat(rows["term"]).dictionary_encode()
    words = coded.dictionary
    rank = np.empty(len(words), np.int64)
    rank[pc.array_sort_indices(words).to_numpy()] = np.arange(len(words))
    code = np.repeat(coded.indices.to_numpy().astype(np.int64), _flat(rows["times"]).to_numpy())
    keys, tf, dl = _flat(rows["key"]), _flat(rows["tf"]).to_numpy(), _flat(rows["dl"]).to_numpy()
    share = tf / (tf + se.K1 * (1 - se.B + se.B * dl / typical))
    band = sum((share < low).astype(np.int32) for low in BANDS[:-1])
    bucket = (_checksums(words) % buckets).astype(np.int32)[code]
    order = np.argsort((bucket * len(BANDS) + band) * np.int64(len(words)) + rank[code], kind="stable")
    places, start = (_flat(rows["places"]).to_numpy(), np.cumsum(tf, dtype=np.int64) - tf) if positions else (None, None)
    for i in range(0, len(order), 1 << 15):
        o = order[i : i + (1 << 15)]
        found = pa.nulls(len(o), pa.list_(pa.int32()))
        if positions:
            ends = np.concatenate(([0], np.cumsum(tf[o])))
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_gathered(places, start[o], tf[o]), pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [words.take(pa.array(code[o])), keys.take(pa.array(o)), pa.array(tf[o]), pa.array(dl[o]), found, pa.array(bucket[o]), pa.array(band[o])],
            names=["term", "key", "tf", "dl", "positions", "bucket", "band"],
        )


@contextmanager
def settings(spark: SparkSession, **values):
    """Settings of the session while something is written."""
    names = {k: f"spark.sql.{k.replace('__', '.')}" for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    try:
        for k, v in values.items():
            spark.conf.set(names[k], v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@dataclass
class Index:
    """An index that stands in a folder."""

    spark: SparkSession
    folder: str
    n: int
    mean: float
    key: str
    kind: str
    buckets: int
    fold: bool
    positions: bool

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "Index":
        return cls(spark, folder, **json.loads(Folder(spark, folder).read(STATISTICS)))

    def _read(self, name: str, values, schema: str, bands=None) -> DataFrame:
        """Rows of the folders that hold the values (terms or stems) and bands; no other folder is listed."""
        buckets = {bucket_of(v, self.buckets) for v in values}
        paths = [f"{self.folder}/{name}/bucket={b}" for b in sorted(buckets) if Folder(self.spark, f"{self.folder}/{name}/bucket={b}").names()]
        if bands is not None:
            paths = [f"{p}/band={i}" for p in paths for i in bands if Folder(self.spark, f"{p}/band={i}").names()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def stems(self, words) -> dict[str, str]:
        """The stems of words."""
        words = sorted(set(words))
        one = self.spark.range(1).select(*[stems.stem(F.lit(w)).alias(f"s{i}") for i, w in enumerate(words)]).first()
        return dict(zip(words, one, strict=True))

    def forms(self, words) -> dict[str, str]:
        """All terms with the stem of one of the words, and that stem."""
        wanted = set(self.stems(words).values())
        rows = self._read("forms", wanted, "stem string, term string, bucket int").where(F.col("stem").isin(*wanted))
        return {r["term"]: r["stem"] for r in rows.collect()}

    def terms(self, words) -> dict[str, dict]:
        """Statistics of the words that are terms, a row each."""
        words = set(words)
        if not words:
            return {}
        rows = self._read("terms", words, "term string, df long, tops array<double>, bucket int").where(F.col("term").isin(*words))
        return {r["term"]: r.asDict() for r in rows.collect()}

    def postings(self, terms, bands=None, positions: bool = False) -> DataFrame:
        """(key, term, tf, dl[, positions], band) of some terms."""
        schema = f"term string, `{self.key}` {self.kind}, tf int, dl int, positions array<int>, bucket int, band int"
        rows = self._read("postings", terms, schema, bands).where(F.col("term").isin(*terms))
        return rows.select(self.key, "term", "tf", "dl", *(["positions"] if positions else []), "band")


def build(docs: DataFrame, folder: str, key: str = "doc_id", fields=("text",), buckets: int = BUCKETS, fold: bool = False, positions: bool = False) -> Index:
    """Write the index of the joined fields of all rows; null texts count as documents without terms.

    Without ``positions`` it is smaller and can't answer phrases.
    """
    spark = docs.sparkSession
    joined = F.concat_ws(" ", *fields)
    tokens = tx.tokens(joined, fold)
    # Bands only have to be about right: any typical length will do.
    typical = max(docs.limit(200).agg(F.avg(F.size(tokens))).first()[0] or 1.0, 1.0)
    facts = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(joined)).alias("size")).first()
    n = facts["n"]
    # A part is a group of terms and a slice of the keys: their number follows the bytes of the texts, so that a part grows with neither the table nor a term.
    slices = max(SLICES, math.ceil((facts["size"] or 0) / PART_BYTES / GROUPS))
    kind = docs.schema[key].dataType.simpleString()
    words = spread(docs.select(key, *fields)).select(F.col(key).alias("key"), F.pmod(F.xxhash64(key), F.lit(slices)).cast("int").alias("slice"), tokens.alias("w"))

    def count_all(batches):
        for batch in batches:
            out = counted(batch, slices, positions)
            if out is not None:
                yield out

    def merge_all(batches):
        rows = list(batches)
        if rows:
            yield from merged(pa.Table.from_batches(rows), typical, buckets, positions)

    sent = words.mapInArrow(count_all, f"part int, term array<string>, times array<int>, key array<{kind}>, tf array<int>, dl array<int>" + (", places array<int>" if positions else ""))
    dealt = sent.repartitionById(GROUPS * slices, "part").mapInArrow(merge_all, f"term string, key {kind}, tf int, dl int, positions array<int>, bucket int, band int")
    dealt = dealt.withColumnRenamed("key", key)
    # Parts come sorted: with a writer for each folder, Spark needn't sort them again.
    with settings(spark, execution__arrow__maxBytesPerBatch=4 << 20, maxConcurrentOutputFileWriters=buckets * len(BANDS) + 1):
        dealt.write.option("compression", "zstd").partitionBy("bucket", "band").parquet(f"{folder}/postings")

    written = spark.read.schema(dealt.schema).parquet(f"{folder}/postings")
    mean = (written.agg(F.sum("tf")).first()[0] or 0) / max(n, 1) or 1.0
    own = impact(F.col("tf"), F.col("dl"), mean)
    tops = F.array(*[F.coalesce(F.max(F.when(F.col("band") == i, own)), F.lit(0.0)) for i in range(len(BANDS))])
    known = written.groupBy("term").agg(F.count("*").alias("df"), tops.alias("tops"))

    def deal(table: DataFrame, by: str, name: str) -> None:
        rows = table.withColumn("bucket", (F.crc32(by) % buckets).cast("int")).repartition(buckets, "bucket")
        rows.sortWithinPartitions("bucket", by).write.partitionBy("bucket").parquet(f"{folder}/{name}")

    deal(known, "term", "terms")
    deal(spark.read.schema(known.schema).parquet(f"{folder}/terms").select(stems.stem(F.col("term")).alias("stem"), "term"), "stem", "forms")
    kept = {"n": n, "mean": mean, "key": key, "kind": kind, "buckets": buckets, "fold": fold, "positions": positions}
    Folder(spark, folder).create(STATISTICS, json.dumps(kept))
    return Index.open(spark, folder)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes when a file of the table does."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [(str(s.getPath()), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where)]
    return hashlib.sha256(repr(sorted(files)).encode()).hexdigest()[:24]


def ensure(spark: SparkSession, path: str, key: str = "doc_id", fields=("text",), fold: bool = False, positions: bool = False) -> Index:
    """The index of a Parquet table in the shared folder: built the first time, and again when the table's files have changed."""
    name = hashlib.sha256(repr((FORMAT, fingerprint(spark, path), key, tuple(fields), fold, positions)).encode()).hexdigest()[:16]
    base = f"{shared_folder(spark)}/quillspark-index"
    marks = Folder(spark, base)
    found = [n for n in marks.names() if n.startswith(f"{name}-") and Folder(spark, f"{base}/{n}").names(STATISTICS)]
    if found:
        return Index.open(spark, f"{base}/{found[0]}")
    try:
        return build(spark.read.parquet(path), f"{base}/{name}-{uuid.uuid4().hex[:8]}", key, fields, fold=fold, positions=positions)
    except Conflict:  # pragma: no cover  the folder's name is new
        return ensure(spark, path, key, fields, fold, positions)


def _idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def _choose(column: str, values: dict) -> Column:
    """The value for the column's key, as a chain of tests over a query's few terms."""
    out = None
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v)) if out is None else out.when(F.col(column) == k, F.lit(v))
    return out


def scores(index: Index, query: str, stemmed: bool = False) -> DataFrame:
    """(key, score) of all documents with a term of the query; stemmed, words of one stem are one term."""
    wanted = se.tx_tokens(query, index.fold)
    forms = index.forms(wanted) if stemmed and wanted else {}
    known = forms if stemmed else index.terms(wanted)
    rows = index.postings(sorted(known))
    if stemmed and known:
        # Forms of one word are summed first; their joint document frequency follows from the same rows.
        rows = rows.withColumn("term", _choose("term", forms)).groupBy(index.key, "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
        idf = {r["term"]: _idf(index.n, r["count"]) for r in rows.groupBy("term").count().collect()}  # the query's stems
    else:
        idf = {t: _idf(index.n, k["df"]) for t, k in known.items()}
    part = _choose("term", idf) * impact(F.col("tf"), F.col("dl"), index.mean) if idf else F.lit(0.0)
    return rows.groupBy(index.key).agg(F.sum(part).alias("score"))


def bm25(index: Index, query: str, limit: int = 5, offset: int = 0, threshold: float = 0.1, allowed: DataFrame | None = None, stemmed: bool = False) -> DataFrame:
    """(key, score, rank, total) like ``search.bm25``, from the index; ``allowed`` holds the keys that may be found."""
    se.check_parameters(threshold, limit=limit, offset=offset)
    hits = scores(index, query, stemmed).where(F.col("score") >= threshold)
    if allowed is not None:
        hits = hits.join(allowed.select(index.key), index.key, "left_semi")
    return se._page(hits, [F.col("score").desc(), F.col(index.key)], limit, offset)


def best(index: Index, query: str, limit: int = 10) -> tuple[DataFrame, list[int]]:
    """((key, score, rank) of the ``limit`` best documents, bands read): exact, without the number of all hits.

    Bands are read from the highest impacts on.  A document not seen yet can reach at most the sum of its terms' largest
    impacts in the bands left; once that is below the limit-th best sum so far, no unseen document can come in.  The seen
    ones that still could are completed from the bands left.
    """
    known = index.terms(se.tx_tokens(query, index.fold))
    if not known:
        return _ranked(scores(index, query), [F.col("score").desc(), F.col(index.key)], limit), []
    idf = {t: _idf(index.n, k["df"]) for t, k in known.items()}
    part = _choose("term", idf) * impact(F.col("tf"), F.col("dl"), index.mean)
    left = lambda t, i: idf[t] * max(known[t]["tops"][i:], default=0.0)
    order = [F.col("score").desc(), F.col(index.key)]
    names = sorted(known)
    top = None
    for i in range(len(BANDS)):
        seen = index.postings(names, range(i + 1)).groupBy(index.key).agg(F.sum(part).alias("score"), F.collect_set("term").alias("terms"))
        rest = {t: left(t, i + 1) for t in names}
        head = [r["score"] for r in seen.orderBy(*order).limit(limit).select("score").collect()]
        if sum(rest.values()) == 0:
            top = seen.select(index.key, "score")
            break
        if len(head) == limit and sum(rest.values()) < head[-1] * (1 - 1e-9):
            missing = sum((F.when(~F.array_contains("terms", t), rest[t]).otherwise(0.0) for t in names), F.lit(0.0))
            open_ = seen.where(F.col("score") + missing >= head[-1] * (1 - 1e-9)).select(index.key)
            full = index.postings(names).join(open_, index.key, "left_semi")
            complete = seen.where((F.col("score") + missing >= head[-1] * (1 - 1e-9)) & (missing > 0)).limit(1).count() == 0
            top = seen.select(index.key, "score") if complete else full.groupBy(index.key).agg(F.sum(part).alias("score"))
            return _ranked(top, order, limit), list(range(i + 1)) if complete else list(range(len(BANDS)))
    return _ranked(top, order, limit), list(range(i + 1))


def _ranked(rows: DataFrame, order: list, limit: int) -> DataFrame:
    from pyspark.sql import Window

    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def phrase(index: Index, words: str) -> DataFrame:
    """(key, n): documents in which the words follow one another, and how often, from positions alone."""
    wanted = se.tx_tokens(words, index.fold)
    if not wanted:
        raise ValueError("a phrase needs a word")
    if not index.positions:
        raise ValueError("the index was built without positions")
    rows = index.postings(sorted(set(wanted)), positions=True)
    # Each word's positions, moved back to the phrase's start; a start that all words share is a hit.
    at = {t: [i for i, w in enumerate(wanted) if w == t] for t in set(wanted)}
    back = lambda o: F.transform("positions", lambda p: p - o)
    starts = lambda t: F.flatten(F.array(*[back(o) for o in at[t]]))
    moved = None
    for t in at:
        moved = F.when(F.col("term") == t, starts(t)) if moved is None else moved.when(F.col("term") == t, starts(t))
    each = rows.select(index.key, F.explode(moved).alias("start")).groupBy(index.key, "start").agg(F.count("*").alias("words"))
    return each.where(F.col("words") == len(wanted)).groupBy(index.key).agg(F.count("*").alias("n"))
