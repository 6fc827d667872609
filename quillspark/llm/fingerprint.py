"""Document fingerprints by a homomorphic multiset hash, in DataFrame expressions only.

A paragraph (a maximal run without line breaks) is hashed to a wide vector: four dense lanes
modulo 2**48 from the whole paragraph, and 65,536 lanes modulo 2**16 where each of its
sentences adds its value to one lane.  A text's fingerprint is the sum of its paragraphs'
vectors, so the order of paragraphs doesn't matter and paragraphs can be added or taken away
later (``plus`` and ``minus``).  Only lanes that aren't zero are stored.

Equal multisets of paragraphs give equal fingerprints.  Likeness is the share of equal stored
lanes (Dice), 1 for equal fingerprints.  Null texts count as empty; an empty text has the zero
vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DENSE, DENSE_BITS, LANE_BITS, VALUE_BITS = 4, 48, 16, 16
_DENSE_MASK, _VALUE_MASK = (1 << DENSE_BITS) - 1, (1 << VALUE_BITS) - 1
#: Rows of one bucket of the id order, and the most buckets (their heads are broadcast).
BUCKET_ROWS, MOST_BUCKETS = 2000, 65536


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body).getItem(0)


def _lanes(sorted_entries: Column) -> Column:
    """Entries (lane << 16 | value) in order, values of one lane summed, zero sums dropped."""
    lane = lambda x: F.shiftright(x, VALUE_BITS)
    heads = lambda e: F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (lane(F.get(e, i)) != lane(F.get(e, i - 1))))

    def total(e, start, end):
        value = F.aggregate(F.slice(e, start + 1, end - start), F.lit(0).cast("long"), lambda acc, x: (acc + x).bitwiseAND(F.lit(_VALUE_MASK)))
        return F.shiftleft(lane(F.get(e, start)), VALUE_BITS).bitwiseOR(value)

    def sums(e):
        return let(heads(e), lambda at: F.transform(at, lambda start, j: total(e, start, F.coalesce(F.get(at, j + 1), F.size(e)))))

    summed = let(sorted_entries, lambda e: F.when(F.size(e) == 0, e).otherwise(sums(e)))
    return F.filter(summed, lambda x: x.bitwiseAND(F.lit(_VALUE_MASK)) != 0)


def vector(text: Column) -> Column:
    """struct(dense array<long>, lanes array<long>) of a text."""
    paragraphs = F.filter(F.split(text, "[\\n\\r]+"), lambda p: p != "")
    sentences = F.filter(F.transform(F.split(text, "[.!?\\n\\r]+"), lambda s: F.trim(s)), lambda s: s != "")
    add = lambda i: lambda acc, p: (acc + F.xxhash64(F.lit(i), p).bitwiseAND(F.lit(_DENSE_MASK))).bitwiseAND(F.lit(_DENSE_MASK))
    dense = let(paragraphs, lambda ps: F.array(*[F.aggregate(ps, F.lit(0).cast("long"), add(i)) for i in range(DENSE)]))
    entries = F.sort_array(F.transform(sentences, lambda s: F.xxhash64(s).bitwiseAND(F.lit((1 << (LANE_BITS + VALUE_BITS)) - 1))))
    return F.struct(dense.alias("dense"), _lanes(entries).alias("lanes"))


def _combine(a: Column, b: Column, sign: int) -> Column:
    dense = F.zip_with(a["dense"], b["dense"], lambda x, y: (x + F.lit(sign) * y).bitwiseAND(F.lit(_DENSE_MASK)))
    turned = b["lanes"] if sign > 0 else F.transform(b["lanes"], lambda x: x - F.lit(2) * x.bitwiseAND(F.lit(_VALUE_MASK)) + F.lit(1 << VALUE_BITS))
    return F.struct(dense.alias("dense"), _lanes(F.sort_array(F.concat(a["lanes"], turned))).alias("lanes"))


def plus(a: Column, b: Column) -> Column:
    """The vector of the paragraphs of both."""
    return _combine(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """The vector of a's paragraphs without b's."""
    return _combine(a, b, -1)


def text_of(v: Column) -> Column:
    """The fingerprint as a string: dense lanes, then a lane and its value at a time, in hex."""
    dense = F.array_join(F.transform(v["dense"], lambda x: F.lpad(F.lower(F.hex(x)), DENSE_BITS // 4, "0")), "")
    lanes = F.array_join(F.transform(v["lanes"], lambda x: F.lpad(F.lower(F.hex(x)), (LANE_BITS + VALUE_BITS) // 4, "0")), "")
    return F.concat(dense, F.lit(":"), lanes)


def likeness(a: Column, b: Column) -> Column:
    """2 * equal lanes / stored lanes; with no lanes on either side, whether the dense lanes are equal."""
    stored = F.size(a["lanes"]) + F.size(b["lanes"])
    shared = 2.0 * F.size(F.array_intersect(a["lanes"], b["lanes"]))
    return F.when(a == b, F.lit(1.0)).when(stored == 0, F.lit(0.0)).otherwise(shared / stored)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next): the next row's text in descending id, after the last the first's.

    Null ids come last; rows of one id are ordered by text.  The id range is cut into buckets;
    each holds, beside its own rows, the first row of the next bucket that isn't empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    low, high, count = rows.agg(F.min("id"), F.max("id"), F.count("*")).first()
    buckets = max(1, min(MOST_BUCKETS, -(-count // BUCKET_ROWS)))
    high, low = (0, 0) if high is None else (high, low)
    width = float(max(1, -(-(high - low + 1) // buckets)))
    place = F.when(F.col("id").isNull(), F.lit(buckets + 1)).otherwise(F.floor((F.lit(float(high)) - F.col("id").cast("double")) / width).cast("int"))
    placed = rows.withColumn("bucket", place)
    from pyspark.sql import Window

    heads = placed.groupBy("bucket").agg(F.max("id").alias("head"))
    order = Window.orderBy("bucket")  # at most MOST_BUCKETS + 2 narrow rows
    last = F.max("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("bucket", F.coalesce(F.lag("bucket").over(order), last).alias("before"), "head")
    joined = placed.join(F.broadcast(heads), "bucket").where("id <=> head")
    both = placed.select("bucket", "id", "text", F.lit(0).alias("extra")).unionAll(joined.select(F.col("before").alias("bucket"), "id", "text", F.lit(1).alias("extra")))
    ahead = Window.partitionBy("bucket").orderBy("extra", F.col("id").desc_nulls_last(), "text")
    return both.withColumn("next", F.lead("text").over(ahead)).where("extra = 0").select("id", "text", "next")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint, and how it stands to an edited text and to the next document."""
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = edited.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next", F.lit(1), third)))
    made = edited.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        let(
            F.struct(vector(F.col("text")).alias("a"), vector(F.col("edited")).alias("b"), vector(F.col("next")).alias("c")),
            lambda v: F.struct(
                text_of(v["a"]).alias("fingerprint"),
                text_of(v["b"]).alias("edited_fingerprint"),
                likeness(v["a"], v["b"]).alias("near_edited"),
                likeness(v["a"], v["c"]).alias("near_next"),
            ),
        ).alias("out"),
    )
    return made.select(id_col, "n_chars", "edited_sha256", "out.fingerprint", "out.edited_fingerprint", "out.near_edited", "out.near_next")


def query(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
