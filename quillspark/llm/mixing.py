"""Mixing sources to target weights by hash-threshold histograms, in DataFrame expressions only.

Every document has a 36-bit hash of its id.  Sizes are summed by source and the hash's upper 12
bits; the bucket in which a source's budget runs out is refined by the next 12 bits, then by
the last 12.  The threshold found so takes a document by comparing its hash: documents are
never sorted, and only the boundary bucket is summed again.

Null texts have size 0.  A null source is a source of its own, after all others.  Documents
with the same id (or a null id) share a hash and are taken together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BITS, LEVELS = 12, 3


def id_hash(doc_id: Column) -> Column:
    """36 bits of the id's md5 as a long."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): the share of all sizes by weight, no source above its limit.

    What a limit cuts off is shared again by weight.  In order of limit / weight the sources at
    their limit come first, so one running sum over the sources finds the level of the rest.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(rank, F.lit(len(weights))) + 1)
    s = by_source.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    s = s.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    chosen = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("level"))))
    lam = chosen.over(everything)["level"]
    s = s.withColumn("lam", lam)
    return s.select("source", "source_size", F.when(F.col("lam").isNull() | (F.col("cap") / F.col("weight") <= F.col("lam")), F.col("cap").cast("double")).otherwise(F.col("lam") * F.col("weight")).alias("target"))


def boundary(sized: DataFrame, found: DataFrame, level: int) -> DataFrame:
    """(source, size, bucket) of the documents in their source's boundary bucket, before anything is summed."""
    shift = BITS * (LEVELS - 1 - level)
    here = sized.select("source", "size", F.shiftright("h", shift + BITS).alias("upper"), F.shiftright("h", shift).alias("bucket"))
    if level:  # the first level has one bucket, of all documents
        at = found.select(F.col("source").alias("of"), "prefix")
        here = here.join(at, F.col("source").eqNullSafe(F.col("of")) & (F.col("upper") == F.col("prefix")), "left_semi")
    return here.drop("upper")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        id_hash(F.col(id_col)).alias("h"),
    )


def thresholds(sized: DataFrame, **how) -> DataFrame:
    """(source, source_size, target, whole, cut): a source takes each document ``whole`` times, and once more under ``cut``.

    The threshold is the one that comes nearest to the rest.
    """
    t = targets(sized, **how)
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    t = t.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    t = materialize(t, "targets")

    # The prefix of the hash up to which all is taken, and what is left of the budget there.
    found = t.select("source", F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("left"))
    for level in range(LEVELS):
        sums = boundary(sized, found, level).groupBy("source", "bucket").agg(F.sum("size").alias("size"))
        at = found.select(F.col("source").alias("of"), "left")
        inside = sums.join(at, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # 4096 rows a source at most
        run = inside.withColumn("sum", F.sum("size").over(upto))
        if level < LEVELS - 1:
            over = F.min(F.when(F.col("sum") > F.col("left"), F.struct("bucket", (F.col("left") - F.col("sum") + F.col("size")).alias("left"))))
            found = run.groupBy("source").agg(over.alias("x")).where("x is not null").select("source", F.col("x.bucket").alias("prefix"), F.col("x.left").alias("left"))
        else:
            nearer = (F.col("sum") <= F.col("left")) | (F.col("sum") - F.col("left") < F.col("left") - F.col("sum") + F.col("size"))
            stop = F.min(F.when(F.col("sum") > F.col("left"), F.struct("bucket", nearer.alias("nearer"))))
            found = run.groupBy("source").agg(stop.alias("x")).where("x is not null").select("source", F.col("x.bucket").alias("bucket"), F.col("x.nearer").alias("nearer"))
        found = materialize(found, "level")
    cut = F.when(F.col("bucket").isNull(), F.lit(1 << (BITS * LEVELS))).otherwise(F.col("bucket") + F.col("nearer").cast("long"))
    return t.join(found, t["source"].eqNullSafe(found["source"]), "left").select(t["source"], "source_size", "target", "whole", F.when(F.col("rest") > 0, cut).otherwise(F.lit(0)).alias("cut"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """(id, size, source_size, target, taken, copies) for every document."""
    sized = materialize(_sized(docs, id_col, text_col, source_col), "sized")
    t = thresholds(sized, **how)
    once = (F.col("h") < F.col("cut")).cast("long")
    return sized.join(t, sized["source"].eqNullSafe(t["source"])).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * (F.col("whole") + once)).alias("taken"), (F.col("whole") + once).alias("copies")
    )


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """Each row as often as the mix takes it, with the columns it has; the number of copies is found on the row itself."""
    sized = materialize(_sized(docs, id_col, text_col, source_col), "sized")
    t = thresholds(sized, **how).select(F.col("source").alias("quill_source"), "whole", "cut")
    t = materialize(t.withColumnsRenamed({"whole": "quill_whole", "cut": "quill_cut"}), "cuts")
    rows = docs.join(t, F.col(source_col).cast("string").eqNullSafe(F.col("quill_source")))
    copies = (F.col("quill_whole") + (id_hash(F.col(id_col)) < F.col("quill_cut")).cast("long")).cast("int")
    return rows.withColumn("quill_copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents, weights 5, 2, 1 repeating, 150 % of all words, no source over 2 times its own."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM by_source),
levels AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
lam AS (SELECT arg_min(level, ratio) AS lam FROM levels WHERE level <= ratio),
targets AS (
  SELECT source, source_size,
         CASE WHEN lam IS NULL OR ratio <= lam THEN cap::DOUBLE ELSE lam * weight END AS target
  FROM levels CROSS JOIN lam),
rests AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole FROM targets),
run AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS own
  FROM sized s JOIN rests t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
