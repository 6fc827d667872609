"""Line dedup by an exact set-similarity join, in DataFrame expressions only.

A line's tokens are its distinct shingles of ``k`` lower-cased words.  A line that has a
similarity (Jaccard) of at least num / den to any line that stands earlier is removed.  Lines of
fewer than ``k`` words are left alone, or with ``short`` have their whole word sequence as their
one token; only blank lines have none then.

1. *Exact copies.*  Lines with equal tokens meet under two independent 64-bit hashes of them;
   partial aggregates keep the first place of each, so thousands of copies become one row per
   map task.
2. *Likely lines.*  In any order of the tokens two similar lines share one of their first
   n - ceil(t * n) + 1 tokens.  By hash, an order that needs no counts, most lines share none and
   are settled; the token sets of the others are fetched.
3. *Rarity.*  The tokens of likely lines are summed in 65,536 hash buckets, a table of fixed size.
   A token's order is then its bucket's class (quarters of the binary logarithm) and its hash, so
   rare tokens come first and every line uses the same total order.
4. *Join.*  A likely line enters the index with as many first tokens by rarity, and tokens that stand
   in one line only leave it.  Two lines meet on such a token and must pass the
   length filter and the positional filter: at the first token that they share, the tokens from
   there on must still allow the overlap that t asks for.  As what tells two lines apart is rare
   and comes first, lines that differ too much are mostly told from the places alone.  First each
   line meets only the earliest line of each of its tokens; lines that it covers are settled, so
   a family of near copies isn't spread to all its pairs.  Lines that are left meet all earlier
   ones.
5. *Verification* on the whole token sets.

"Earlier" is the order of (id, hash of the whole text, place of the line).  Null ids come after
all others.  Rows that share id and text are one document: none of their lines is later than its
own repetition.  Null texts stay null, empty texts empty, blank lines stay; an empty table gives
an empty result.  Columns of the input stay, but for ``n_lines`` and ``n_removed``, which are
replaced.  Tokens are 56-bit hashes.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.fingerprint import let
from quillspark.llm.shared import Table, free, materialize

BUCKETS, HASH_BITS = 1 << 16, 56
_MASK = (1 << HASH_BITS) - 1
_LAST = (1 << 63) - 1
PLACE = ["id", "th", "at"]


def _words(line: Column) -> Column:
    """The words of a line; one empty string where it has none."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for space in ("  ", *"\t\n\x0b\x0c\r"):
        odd = odd | F.contains(line, F.lit(space))
    # Most lines have single blanks alone between words: a plain split, without the regular expression.
    return F.when(odd, F.split(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")).otherwise(F.split(line, " "))


def hashes(line: Column) -> Column:
    """The hashes of a line's words."""
    return F.transform(_words(line), lambda w: F.xxhash64(w))


def _few(h: Column, k: int) -> Column:
    return (F.size(h) < k) | (F.get(h, F.lit(0)) == F.xxhash64(F.lit("")))


def _starts(h: Column, k: int) -> Column:
    return F.slice(h, F.lit(1), F.size(h) - (k - 1))


def _gram(h: Column, x: Column, i: Column, k: int) -> Column:
    return F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)])


def _whole(h: Column, k: int, short: bool) -> Column:
    """The shingles of a line of few words."""
    none = F.array().cast(T.ArrayType(T.LongType(), False))
    return F.when(F.get(h, F.lit(0)) == F.xxhash64(F.lit("")), none).otherwise(F.array(F.xxhash64(h, F.size(h)))) if short else none


def shingles(line: Column, k: int, short: bool = False) -> Column:
    """64-bit hashes of a lower-cased line's k-word shingles, repeated ones included; fewer words make none, or one if short."""
    grams = lambda h: F.transform(_starts(h, k), lambda x, i: _gram(h, x, i, k))
    return let(hashes(line), lambda h: F.when(_few(h, k), _whole(h, k, short)).otherwise(grams(h)))


def tokens(line: Column, k: int, short: bool = False) -> Column:
    """The shingles cut to HASH_BITS, so that a class of rarity has room before them."""
    return F.transform(shingles(line, k, short), lambda t: t.bitwiseAND(F.lit(_MASK)))


def judged(line: Column, k: int, short: bool) -> Column:
    """Whether a line has a token set: by its words alone, so that no filter makes tokens a second time."""
    return line.rlike(r"[^\x20\x09-\x0D]" if short else rf"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{k - 1}}}[^\x20\x09-\x0D]")


def _lines(rows: DataFrame, k: int, short: bool) -> DataFrame:
    """The lines that have a token set, each with its text and place."""
    return rows.select("id", "th", F.posexplode(F.split("lowered", "\n")).alias("at", "line")).where(judged(F.col("line"), k, short))


def _bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _classes(token: DataFrame) -> list[int]:
    """The class of each hash bucket over the tokens of a column t."""
    counts = token.groupBy(_bucket(F.col("t")).alias("bucket")).count()
    out = [0] * BUCKETS
    for bucket, n in counts.collect():  # BUCKETS rows at most
        out[bucket] = min(127, 1 + int(4 * math.log2(n)))
    return out


def rarity_classes(rows: DataFrame, k: int, short: bool = False) -> list[int]:
    """The class of each hash bucket over all lines of some texts.

    Only counts are wanted here, so shingles are hashed as rows behind an explode, in generated code, and not in an array.
    """
    h = F.col("h")
    lines = _lines(rows, k, short).select(hashes(F.col("line")).alias("h"))
    starts = lines.select("h", F.posexplode(F.when(_few(h, k), _whole(h, k, short)).otherwise(_starts(h, k))).alias("i", "x"))
    gram = _gram(h, F.col("x"), F.col("i"), k)
    return _classes(starts.select((F.when(_few(h, k), F.col("x")).otherwise(gram) if short else gram).alias("t")))


def by_rarity(tokens: Column, classes: list[int]) -> Column:
    """Distinct tokens in order of rarity; class and hash packed in one long."""
    table = F.from_json(F.lit(json.dumps(classes)), "array<int>")  # a constant of the plan
    key = lambda t: F.shiftleft(F.get(table, _bucket(t)).cast("long"), HASH_BITS).bitwiseOR(t)
    # No key is null, but Spark doesn't know; told so, it sorts longs and no objects.
    return F.sort_array(F.transform(tokens, lambda t: F.coalesce(key(t), F.lit(0).cast("long"))))


def ranked(line: Column, k: int, classes: list[int], short: bool = False) -> Column:
    """A line's distinct tokens in order of rarity."""
    return by_rarity(F.array_distinct(tokens(line, k, short)), classes)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, short: bool = False, drop_emptied: bool = False) -> DataFrame:
    """The documents' rows and columns with later similar lines removed, and n_lines, n_removed added.

    With ``drop_emptied`` (and ``short``) documents go of which only blank lines would be left.
    """
    if drop_emptied and not short:
        raise ValueError("documents are emptied for certain only where short lines are judged too")
    spark, text = docs.sparkSession, F.col(text_col).cast("string")
    key = {"id": F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), "th": F.xxhash64(F.lit(1), text)}
    rows = docs.select(*[c.alias(n) for n, c in key.items()], F.lower(text).alias("lowered"))

    need = lambda n: F.floor((n * num + (den - 1)) / den)  # noqa: E731  the least overlap with any partner
    prefix = lambda t: F.slice(t, F.lit(1), (F.size(t) - need(F.size(t)) + 1).cast("int"))
    # An index has the same columns and no nulls on both sides of its join, so that both read one exchange.
    several = lambda index, other: index.groupBy("token").agg(F.count(other).alias("lines")).where("lines > 1").select("token").hint("shuffle_hash")
    sets = _lines(rows, k, short).select(*PLACE, F.sort_array(F.array_distinct(shingles(F.col("line"), k, short))).alias("tokens"))
    keyed = sets.select(
        F.struct(*PLACE).alias("place"),
        F.xxhash64(F.lit(1), "tokens").alias("k1"),
        F.xxhash64(F.lit(2), "tokens").alias("k2"),
        F.size("tokens").alias("n"),
        prefix("tokens").alias("prefix"),
    )
    firsts = keyed.groupBy("k1", "k2", "n").agg(F.min("place").alias("place"), F.first("prefix").alias("prefix"))
    firsts = materialize(firsts.select(F.monotonically_increasing_id().alias("line"), "place.*", "prefix"), "firsts")

    # Lines that can have a partner: those with a token of the prefix by hash in common with another.  Most tokens stand
    # in one line, so they are counted where they are dealt to: partial aggregates wouldn't make fewer rows.
    index = firsts.where("line is not null").select("line", F.explode("prefix").alias("token")).repartition("token")
    likely = materialize(index.join(several(index, "line"), "token").select("line").distinct(), "likely")
    free(spark)  # the index's shuffle files go before those of the texts come
    wanted = firsts.select("line", *PLACE).join(likely, "line")
    wanted = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("at", "line")).alias("wanted"))  # the lines of one text
    fetched = rows.join(wanted, ["id", "th"]).dropDuplicates(["id", "th"])
    # A text is split once, before its lines are exploded.
    line = lambda lines: lambda w: F.struct(w["line"].alias("line"), F.get(lines, w["at"]).alias("words"))
    fetched = fetched.select(F.explode(let(F.split("lowered", "\n"), lambda lines: F.transform("wanted", line(lines)))).alias("w"))
    fetched = fetched.select("w.line", F.array_distinct(tokens(F.col("w.words"), k, short)).alias("tokens"))  # in any order
    fetched_table = Table(fetched, "fetched")
    fetched = fetched_table.df
    free(spark)

    # The index of these lines by rarity, without tokens that stand in one line, and with the lines' places.
    classes = _classes(fetched.select(F.explode("tokens").alias("t")))
    index = fetched.where("line is not null").select("line", by_rarity(F.col("tokens"), classes).alias("tokens"))
    index = index.select("line", F.shiftleft(F.size("tokens").cast("long"), 32).alias("n"), F.posexplode(prefix("tokens")).alias("i", "token"))
    index = index.select("token", F.struct("line", F.col("n").bitwiseOR(F.col("i").cast("long")).alias("ni")).alias("at")).repartition("token")
    met = index.join(several(index, "at"), "token").select("token", "at.*").join(firsts.select("line", *PLACE), "line")
    met = met.select("token", F.struct(*PLACE, "line", F.shiftright("ni", 32).cast("int").alias("n"), F.col("ni").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("i")).alias("b"))
    met_table = Table(met, "met")
    own = met_table.df
    free(spark)

    place = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in PLACE])
    both = F.col("a.n") + F.col("b.n")
    overlap = F.ceil(both * F.lit(num) / F.lit(num + den))
    lengths = (F.col("a.n") * num <= F.col("b.n") * den) & (F.col("b.n") * num <= F.col("a.n") * den)
    places = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) >= overlap
    near = (place("a") < place("b")) & lengths & places

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of some pairs the later lines of those that are similar."""
        out = pairs.select(F.col("a.line").alias("a"), F.col("b.line").alias("b")).distinct()
        for s in "ab":
            out = out.join(fetched.select(F.col("line").alias(s), F.col("tokens").alias(f"{s}_tokens")), s)
        shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
        similar = out.where(shared * den >= (F.size("a_tokens") + F.size("b_tokens") - shared) * num)
        out = materialize(similar.select(F.col("b").alias("line")).distinct(), name)
        free(spark)
        return out

    # First every line against the earliest of each of its tokens: most of a large family ends here.
    hubs = own.groupBy("token").agg(F.min("b").alias("a"))
    covered = verified(own.join(hubs, "token").where(near), "covered")

    # Then the lines that are left against all earlier ones.
    rest = own.join(covered, F.col("b.line") == F.col("line"), "left_anti")
    pairs = rest.join(own.withColumnRenamed("b", "a"), "token").where(near)
    covered = covered.unionAll(verified(pairs, "covered")).distinct()
    for table in (met_table, fetched_table):
        table.drop()

    kept = firsts.select("line", *PLACE).join(covered, "line", "left_anti")
    kept = kept.groupBy("id", "th").agg(F.collect_list("at").alias("quill_kept")).withColumnsRenamed({"id": "quill_id", "th": "quill_th"})
    joined = docs.withColumns({"quill_key": key["id"], "quill_hash": key["th"]})
    joined = joined.join(kept.hint("shuffle_hash"), (F.col("quill_key") == F.col("quill_id")) & (F.col("quill_hash") == F.col("quill_th")), "left")
    if drop_emptied:  # tested on the text as it was: a test of what is left would be pushed below and repeat the work
        joined = joined.where(F.col("quill_kept").isNotNull() | F.coalesce(~judged(text, k, short), F.lit(True)))
    joined = joined.withColumn("quill_lines", F.split(text, "\n"))
    at = F.sequence(F.lit(0), F.size("quill_lines") - 1)
    other = F.array_except(at, F.coalesce(F.col("quill_kept"), F.array().cast("array<int>")))
    joined = joined.withColumn("quill_gone", F.filter(other, lambda i: judged(F.get(F.col("quill_lines"), i), k, short)))
    left = F.transform(F.array_except(at, F.col("quill_gone")), lambda i: F.get(F.col("quill_lines"), i))
    extra = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    number = lambda c: F.when(text.isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    return joined.select(
        *[F.col(c) for c in extra],
        F.when(F.size("quill_gone") > 0, F.array_join(left, "\n")).otherwise(text).alias(text_col),
        number("quill_lines").alias("n_lines"),
        number("quill_gone").alias("n_removed"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All documents: five words, a similarity of 0.8 or more; the digest of what stays."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def query_all_lines(spark, sf_dir: str) -> DataFrame:
    """The same with lines of fewer than five words judged too."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), short=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln
  FROM documents),
words AS (SELECT doc_id, ln, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM lines),
grams AS (
  SELECT DISTINCT doc_id, ln, unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(list_slice(w, j, j + 4), ' '))) AS g
  FROM words WHERE len(w) >= 5),
sizes AS (SELECT doc_id, ln, count(*) AS n FROM grams GROUP BY ALL),
shared AS (
  SELECT a.doc_id AS ad, a.ln AS aa, b.doc_id AS bd, b.ln AS ba, count(*) AS s
  FROM grams a JOIN grams b ON a.g = b.g AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.ln < b.ln))
  GROUP BY ALL),
gone AS (
  SELECT DISTINCT bd AS doc_id, ba AS ln
  FROM shared JOIN sizes x ON x.doc_id = ad AND x.ln = aa JOIN sizes y ON y.doc_id = bd AND y.ln = ba
  WHERE 100 * s >= 80 * (x.n + y.n - s))
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(g.ln)::BIGINT AS n_removed,
       md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (WHERE g.ln IS NULL), '')) AS kept_md5
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.ln = l.ln
GROUP BY l.doc_id
"""

_GRAMS = "unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(list_slice(w, j, j + 4), ' '))) AS g\n  FROM words WHERE len(w) >= 5)"
_ALL_GRAMS = "unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda j: array_to_string(list_slice(w, j, j + 4), ' ')) ELSE [array_to_string(w, ' ')] END) AS g\n  FROM words WHERE len(w) >= 1)"
ORACLE_ALL_LINES = ORACLE.replace(_GRAMS, _ALL_GRAMS)
