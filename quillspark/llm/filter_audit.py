"""What each of five document filters takes, in every order that they can be applied in.

The bytes of an Arrow batch are classed by table look-up; prefix sums of the classes count code points, capitals and
symbols, and the word hashes of each document, sorted, count distinct words (equal hashes are verified byte by byte).  A
document is then a mask of the filters that it fails, and everything else follows from counts of masks in each part.

A text fails E if a row with a smaller id has the same text (its sha256); ids are compared as longs.  Rows with a null id
never fail E and make no other row fail it; rows of one id don't make each other fail.  A null text is empty; an empty
text fails A and passes B and C.  A null source is the part ''.  Of repeated labels of an id the largest counts; a document
without labels is neither good nor toxic.  An empty table gives an empty result.  Other columns are never looked at.

Only rows of some 60 bytes are shuffled: by id to their labels and by (text digest, id) to the first of their text, so that
copies of one text spread over all tasks.  The counts are at most 128 rows a part.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.shared import bound_batches, materialize

LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, "#$%&*|"
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
_CAPITAL, _SYMBOL, _FIRST = np.zeros((3, 256), bool)
_CAPITAL[65:91] = True
_SYMBOL[list(SYMBOLS.encode())] = True
_FIRST[:] = (np.arange(256) & 0xC0) != 0x80


def per_row(marks: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The number of marked bytes of each row, by prefix sums."""
    total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from each a equal those from b."""
    out = np.ones(len(a), bool)
    for at, to in tk.chunks(np.concatenate(([0], np.cumsum(size)))):
        n = size[at:to]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differs = data[np.repeat(a[at:to], n) + step] != data[np.repeat(b[at:to], n) + step]
        out[np.repeat(np.arange(at, to), n)[differs]] = False
    return out


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of words and of distinct words of each row."""
    starts, ends = tk.spans(~tk.SPACE[data], offs)
    row, size = np.searchsorted(offs, starts, side="right") - 1, ends - starts
    n = np.bincount(row, minlength=len(offs) - 1)
    hashes = tk.hash_spans(data, starts, ends)
    order = np.lexsort((hashes, row))
    before, after = order[:-1], order[1:]
    repeat = (row[before] == row[after]) & (hashes[before] == hashes[after])
    equal = repeat & (size[before] == size[after])
    pairs = np.flatnonzero(equal)
    equal[pairs] = _same(data, starts[before[pairs]], starts[after[pairs]], size[before[pairs]])
    distinct = n - np.bincount(row[after[equal]], minlength=len(n))
    for i in np.unique(row[after[repeat & ~equal]]):  # different words of one hash: that row by its bytes
        distinct[i] = len({data[s:e].tobytes() for s, e in zip(starts[row == i], ends[row == i], strict=True)})
    return n, distinct


def masks(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The filters A to D that each row fails, a bit each from the lowest."""
    n, distinct = words(data, offs)
    fails = (
        n < LEAST_WORDS,
        100 * distinct < DISTINCT_PERCENT * n,
        100 * per_row(_CAPITAL[data], offs) > CAPITAL_PERCENT * per_row(_FIRST[data], offs),
        per_row(_SYMBOL[data], offs) > 0,
    )
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _scan(batches):
    for batch in batches:
        data, offs = tk.utf8(batch.column(2))
        digests, found = [], np.zeros(len(batch), np.int32)
        for at, to in tk.chunks(offs, 1 << 20):
            part = data[offs[at] : offs[to]]
            found[at:to] = masks(part, offs[at : to + 1] - offs[at])
            view = memoryview(np.ascontiguousarray(part))
            bounds = (offs[at : to + 1] - offs[at]).tolist()
            digests += [hashlib.sha256(view[a:b]).digest() for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array(digests, pa.binary())], names=["id", "part", "mask", "digest"])
    tk.release()


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask, digest) of every row: the filters A to D that its text fails and the text's sha256."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, "id long, part string, mask int, digest binary")


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows with the marks ``good`` (quality 1) and ``toxic`` (toxic 1)."""
    mark = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(c)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("label_id")).agg(mark("quality"), mark("toxic"))
    joined = rows.join(known, F.col("id") == F.col("label_id"), "left")
    return joined.select(*rows.columns, F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def counted(rows: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters A to E that they fail."""
    cell = ["part", "mask", "good", "toxic"]
    first = rows.where("id is not null").groupBy(F.col("digest").alias("d"), F.col("part").alias("p")).agg(F.min("id").alias("first"))
    first = first.groupBy("d").agg(F.min("first").alias("first"))
    kept = rows.join(first, (F.col("digest") == F.col("d")) & (F.col("id") == F.col("first")), "left_semi")
    kept = kept.unionByName(rows.where("id is null")).groupBy(*cell).agg(F.count("*").alias("n"))
    later = rows.groupBy(*cell).agg(F.count("*").alias("n")).unionByName(kept.withColumn("n", -F.col("n")))
    both = kept.unionByName(later.withColumn("mask", F.col("mask").bitwiseOR(F.lit(DUPLICATE))))
    return both.groupBy(*cell).agg(F.sum("n").alias("n")).where("n > 0")


ORDERS = ["".join(p) for p in permutations(FILTERS)]


def selections() -> dict[str, np.ndarray]:
    """For each order and step (600 rows), the masks that count as kept, removed, redundant or failing that filter only."""
    every = np.arange(1 << len(FILTERS))
    out = {k: np.zeros((len(ORDERS) * len(FILTERS), len(every)), np.int64) for k in ("kept", "removed", "redundant", "unique_fails")}
    at = 0
    for order in ORDERS:
        before = 0
        for f in order:
            bit = 1 << FILTERS.index(f)
            fails, gone = (every & bit) != 0, (every & before) != 0
            out["kept"][at], out["removed"][at] = ~fails & ~gone, fails & ~gone
            out["redundant"][at], out["unique_fails"][at] = fails & gone, every == bit
            before, at = before | bit, at + 1
    return out


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _orders(batches):
    chosen, steps = selections(), len(FILTERS)
    step_filter = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    for batch in batches:
        cells = batch.column(1)
        for i, part in enumerate(batch.column(0).to_pylist()):
            counts = np.zeros((3, 1 << len(FILTERS)), np.int64)
            for c in cells[i].as_py():
                for row, use in enumerate((True, c["good"], c["toxic"])):
                    counts[row, c["mask"]] += c["n"] if use else 0
            out = {k: m @ counts[0] for k, m in chosen.items()}
            out |= {"good_lost": chosen["removed"] @ counts[1], "toxic_lost": chosen["removed"] @ counts[2]}
            out["shapley"] = np.bincount(step_filter, out["removed"], steps).astype(np.int64)[step_filter]
            n = len(step_filter)
            yield pa.RecordBatch.from_pydict({"part": [part] * n, "filter_order": [o for o in ORDERS for _ in o], "step": pa.array(np.arange(n) % steps + 1, pa.int32())} | out)


def audit(cells: DataFrame) -> DataFrame:
    """Rows of RESULT: 120 orders of 5 steps for each part.  A part's cells are 128 at most."""
    per = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    return per.mapInArrow(_orders, RESULT)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of a table of documents with its labels (id, quality, toxic)."""
    return audit(counted(materialize(labelled(failures(docs, id_col, text_col, part_col), labels, id_col), "audit")))


def query(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = f"""WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (len(w) < {LEAST_WORDS})::INT AS a, (100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w))::INT AS b,
  (100 * (strlen(text) - strlen(regexp_replace(text, '[A-Z]', '', 'g'))) > {CAPITAL_PERCENT} * length(text))::INT AS c,
  regexp_matches(text, '[{SYMBOLS}]')::INT AS d, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)::INT AS e FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
n AS (SELECT part, good, toxic, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
o AS (SELECT [p.i, q.i, r.i, s.i, u.i] AS p FROM f p, f q, f r, f s, f u WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
k AS (SELECT list_aggregate(list_transform(p, lambda i: 'ABCDE'[i + 1]), 'string_agg', '') AS filter_order, k AS step, (1 << p[k])::INT AS bit,
  coalesce(list_sum(list_transform(p[1:k - 1], lambda i: 1 << i)), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
x AS (SELECT part, filter_order, step, bit,
  sum(n) FILTER (mask & (bit | before) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed,
  sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
  sum(n) FILTER (mask & bit > 0 AND mask & before = 0 AND good = 1) AS good_lost, sum(n) FILTER (mask & bit > 0 AND mask & before = 0 AND toxic = 1) AS toxic_lost
  FROM n, k GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x"""
