"""Searches over a knowledge base: a DataFrame with a key, text fields, tags and vectors.

Every ranking has the key as its last criterion, so results don't depend on partitioning.
Small parameters (query terms, one query vector, limits) become literals of the plan; top-k is
``orderBy().limit()``, which Spark runs as a partial top-k in each partition.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fuzzy, text as tx
from quillspark.functions.arrow import bound_batches
from quillspark.functions.stems import once

K1, B = 1.2, 0.75


def check_parameters(threshold: float = 0.0, low: float = 0.0, high: float = float("inf"), limit: int = 1, offset: int = 0, tags=None, direction: str = "OUTBOUND") -> None:
    """Refuse parameters that no search can mean."""
    if not low <= threshold <= high:
        raise ValueError(f"threshold {threshold} isn't between {low} and {high}")
    if limit < 1 or offset < 0:
        raise ValueError("limit must be 1 or more, offset 0 or more")
    if direction not in ("OUTBOUND", "INBOUND", "ANY"):
        raise ValueError(f"unknown direction {direction}")
    if tags is not None and not all(isinstance(t, str) for t in tags):
        raise ValueError("tags must be strings")


def _page(hits: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """Rows of one page with their rank and the number of all hits."""
    ranked = hits.orderBy(*order).limit(limit + offset)
    total = hits.agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.orderBy(*order))
    return ranked.withColumn("rank", rank).where(F.col("rank") > offset).crossJoin(F.broadcast(total))  # one row


def previewed(page: DataFrame, docs: DataFrame, key: str, fields, size: int = 500) -> DataFrame:
    """A page's rows with fields of their documents, texts cut to a preview; the page, a few rows, is broadcast."""
    kind = dict(docs.dtypes)
    cut = lambda f: tx.preview(F.col(f), size).alias(f) if kind[f] == "string" else F.col(f)
    found = docs.select(F.col(key).alias("_found"), *[cut(f) for f in fields])
    joined = found.join(F.broadcast(page), F.col("_found") == F.col(key)).drop("_found")
    return joined.select(*page.columns, *[f for f in fields if f not in page.columns])


def envelope(page: DataFrame, hits_total: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One row (results, total, offset, limit): a page's rows by rank in an array, also where the page is empty.

    ``hits_total`` is one row with the column total.
    """
    rows = [c for c in page.columns if c != "total"]
    ordered = F.sort_array(F.collect_list(F.struct("rank", *[c for c in rows if c != "rank"])))
    results = page.agg(ordered.alias("results"))
    return results.crossJoin(F.broadcast(hits_total.select("total"))).select("results", "total", F.lit(offset).alias("offset"), F.lit(limit).alias("limit"))  # one row each


def bm25(docs: DataFrame, query: str, key: str = "doc_id", fields=("text",), limit: int = 5, offset: int = 0, threshold: float = 0.1, tags=None, tags_col: str = "tags", fold: bool = False) -> DataFrame:
    """(key, score, rank, total): one page of ``bm25_scores`` at the threshold or above."""
    check_parameters(threshold, limit=limit, offset=offset, tags=tags)
    scored = bm25_scores(docs, query, key, fields, tags, tags_col, fold)
    return _page(scored.where(F.col("score") >= threshold), [F.col("score").desc(), F.col(key)], limit, offset)


def bm25_scores(docs: DataFrame, query: str, key: str = "doc_id", fields=("text",), tags=None, tags_col: str = "tags", fold: bool = False) -> DataFrame:
    """(key, score) by BM25 over the joined fields of all rows with any of the query's terms.

    Term frequencies of the query's terms are counted inside the row; the corpus statistics
    (documents, mean length, document frequencies) are one aggregate.  Nothing is shuffled but
    partial sums and top rows.
    """
    terms = sorted(set(tx_tokens(query, fold)))
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    words = docs.select(key, tx.tokens(F.concat_ws(" ", *fields), fold).alias("w"), *([tags_col] if tags else []))
    count = lambda t: F.size(F.filter("w", lambda x: x == t))
    freq = words.select(key, F.size("w").alias("dl"), *[count(t).alias(f"tf{i}") for i, t in enumerate(terms)], *([tags_col] if tags else []))
    stats = freq.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))]).first()
    n, mean = stats["n"], stats["avgdl"] or 1.0

    def part(i):
        df = stats[f"df{i}"] or 0
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        tf = F.col(f"tf{i}")
        return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean))))

    hit = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    hits = freq.where(hit)
    if tags:
        hits = hits.where(tx.has_all_tags(F.col(tags_col), tags))
    return hits.select(key, reduce(lambda a, b: a + b, [part(i) for i in range(len(terms))]).alias("score"))


def tx_tokens(text: str, fold: bool = False) -> list[str]:
    """The analyzer's tokens of a driver-side string."""
    low = text.lower().translate(str.maketrans(tx.ACCENTED, tx.PLAIN)) if fold else text.lower()
    return [t for t in re.split(r"[\W_]+", low) if t]


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0 or a vector is null or of another length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot / length)


def semantic(docs: DataFrame, vector, key: str = "vec_id", vector_col: str = "embedding", limit: int = 5, threshold: float = 0.5, tags=None, tags_col: str = "tags", offset: int = 0) -> DataFrame:
    """(key, score, rank, total) by cosine with one query vector; similarity is computed once a row."""
    check_parameters(threshold, -1.0, 1.0, limit=limit, tags=tags)
    rows = docs.where(F.col(vector_col).isNotNull())
    if tags:
        rows = rows.where(tx.has_all_tags(F.col(tags_col), tags))
    q = F.lit([float(x) for x in vector])
    scored = rows.select(key, cosine(F.col(vector_col), q).alias("score")).where(F.col("score") >= threshold)
    return _page(scored, [F.col("score").desc(), F.col(key)], limit, offset)


def fuse(first: DataFrame, second: DataFrame, key: str, limit: int = 10, rrf_k: int = 60, offset: int = 0) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists with columns key, score and rank."""
    a = first.select(key, F.col("score").alias("bm25_score"), F.col("rank").alias("r1"))
    b = second.select(key, F.col("score").alias("similarity_score"), F.col("rank").alias("r2"))
    both = a.join(b, key, "full_outer")
    part = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0))
    scored = both.select(key, F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), F.coalesce("similarity_score", F.lit(0.0)).alias("similarity_score"), (part("r1") + part("r2")).alias("hybrid_score"))
    return _page(scored, [F.col("hybrid_score").desc(), F.col(key)], limit, offset)


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, vector, key: str = "doc_id", limit: int = 10, k: int = 20, bm25_threshold: float = 0.01, similarity_threshold: float = 0.70, rrf_k: int = 60, fields=("text",), vector_col: str = "embedding") -> DataFrame:
    """BM25 and cosine candidates fused by rank."""
    return fuse(bm25(docs, query, key, fields, k, 0, bm25_threshold), semantic(vectors, vector, key, vector_col, k, similarity_threshold), key, limit, rrf_k)


def keyword_search(docs: DataFrame, keywords, fields, key: str = "doc_id", tags_col: str = "tags", tags=None, mode: str = "OR", limit: int = 10, offset: int = 0) -> DataFrame:
    """A keyword hits if a field contains it or it is a tag; hits with most wanted tags come first."""
    words = tx.clean_keywords(keywords)
    in_field = lambda w: reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(f), F.lit(w)), F.lit(False)) for f in fields]) | F.coalesce(F.array_contains(tags_col, w), F.lit(False))
    tests = [in_field(w) for w in words]
    hit = reduce((lambda a, b: a & b) if mode == "AND" else (lambda a, b: a | b), tests) if tests else F.lit(True)
    overlap = tx.tag_overlap(F.col(tags_col), tags or words) if (tags or words) else F.lit(0)
    rows = docs.where(hit).select(key, overlap.alias("overlap"))
    if tags:
        rows = docs.where(hit & tx.has_all_tags(F.col(tags_col), tags)).select(key, overlap.alias("overlap"))
    return _page(rows, [F.col("overlap").desc(), F.col(key)], limit, offset)


def tag_search(docs: DataFrame, tags, key: str = "doc_id", tags_col: str = "tags", mode: str = "OR", limit: int = 10, offset: int = 0) -> DataFrame:
    """Documents with any or all of the tags, by overlap."""
    overlap = tx.tag_overlap(F.col(tags_col), tags)
    rows = docs.select(key, overlap.alias("overlap")).where(F.col("overlap") >= (len(set(tags)) if mode == "AND" else 1))
    return _page(rows, [F.col("overlap").desc(), F.col(key)], limit, offset)


def view_search(docs: DataFrame, query: str, fields, key: str = "doc_id", tags=None, tags_col: str = "tags", limit: int = 10, offset: int = 0) -> DataFrame:
    """All query tokens in one field and all tags; by BM25 without a threshold.  No criterion finds nothing."""
    want = tx_tokens(query or "")
    if not want and not tags:
        return _page(docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False)), [F.col(key)], limit, offset)
    rows = docs
    if want:
        in_field = lambda f: F.size(F.array_except(F.array(*[F.lit(t) for t in sorted(set(want))]), tx.tokens(F.col(f)))) == 0
        rows = rows.where(reduce(lambda a, b: a | b, [in_field(f) for f in fields]))
    if tags:
        rows = rows.where(tx.has_all_tags(F.col(tags_col), tags))
    if not want:
        return _page(rows.select(key, F.lit(0.0).alias("score")), [F.col(key)], limit, offset)
    scored = bm25_scores(docs, query, key, fields)
    return _page(scored.join(rows.select(key), key, "left_semi"), [F.col("score").desc(), F.col(key)], limit, offset)


def newest(rows: DataFrame, fields, time_col: str, key: str, term: str | None = None, role=None, role_col: str = "role", limit: int = 10, tags=(), tags_col: str = "tags") -> DataFrame:
    """LIKE over the fields, all tags and a role, newest first; tags are a list, or its JSON text, in which they stand in quotes."""
    as_text = bool(tags) and rows.schema[tags_col].dataType.simpleString() == "string"
    for t in tags:
        if isinstance(t, str):
            rows = rows.where(F.contains(F.lower(tags_col), F.lit(f'"{t.lower()}"')) if as_text else F.array_contains(tags_col, t))
    hits = rows.where(tx.like_any([F.col(f) for f in fields], term)) if term else rows
    hits = hits.where(F.col(role_col) == role) if role is not None else hits
    return hits.orderBy(F.col(time_col).desc(), F.col(key)).limit(limit)


def substring_search(docs: DataFrame, query: str, key: str = "doc_id", text_col: str = "text", limit: int = 10, offset: int = 0) -> DataFrame:
    """Texts that contain the query; relevance is len(query) / len(text)."""
    rows = docs.where(F.contains(F.lower(text_col), F.lit(query.lower()))).select(key, (F.lit(float(len(query))) / F.greatest(F.length(text_col), F.lit(1))).alias("relevance"))
    return _page(rows, [F.col("relevance").desc(), F.col(key)], limit, offset)


def fuzzy_tags(docs: DataFrame, keywords, key: str = "doc_id", tags_col: str = "tags", least: float = 97.0, limit: int = 10, offset: int = 0) -> DataFrame:
    """Documents that share a tag with the keywords, by how many keywords are like some tag; blank keywords find nothing."""
    words = tx.clean_keywords(keywords)
    if not words:
        return _page(docs.select(key, F.lit(0).alias("matches")).where(F.lit(False)), [F.col(key)], limit, offset)
    rows = docs.where(F.arrays_overlap(tags_col, F.array(*[F.lit(w) for w in words])))
    n = reduce(lambda a, b: a + b, [(fuzzy.ratio_udf(w)(F.col(tags_col)) >= least).cast("int") for w in words])
    return _page(rows.select(key, n.alias("matches")).where("matches > 0"), [F.col("matches").desc(), F.col(key)], limit, offset)


def fuzzy_text(docs: DataFrame, keywords, fields, key: str = "doc_id", mode: str = "OR", least: float = 97.0, limit: int = 10, offset: int = 0) -> DataFrame:
    """LIKE first, natively; then the best partial ratio of each keyword in any field.

    A keyword scores its ratio where that is ``least`` or more; the sum ranks the documents.
    Blank keywords find nothing.
    """
    words = tx.clean_keywords(keywords)
    if not words:
        return _page(docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False)), [F.col(key)], limit, offset)
    join = (lambda a, b: a & b) if mode == "AND" else (lambda a, b: a | b)
    rows = docs.where(reduce(join, [tx.like_any([F.col(f) for f in fields], w) for w in words]))
    bound_batches(docs.sparkSession)
    lowered = rows.select(key, *[F.lower(f).alias(f"_l{i}") for i, f in enumerate(fields)])
    best = lambda w: F.greatest(*[fuzzy.partial_udf(w, least)(F.col(f"_l{i}")) for i in range(len(fields))], F.lit(0.0))
    scored = lowered.select(key, *[best(w).alias(f"s{i}") for i, w in enumerate(words)])
    passing = [F.when(F.col(f"s{i}") >= least, F.col(f"s{i}")).otherwise(0.0) for i in range(len(words))]
    hit = reduce(join, [F.col(f"s{i}") >= least for i in range(len(words))])
    return _page(scored.where(hit).select(key, reduce(lambda a, b: a + b, passing).alias("score")), [F.col("score").desc(), F.col(key)], limit, offset)


def embed_text(text: Column, dims: int = 64) -> Column:
    """A vector without a model: hashed token counts of length 1; null for an empty text."""
    if dims < 1:
        raise ValueError("a vector needs a dimension")
    # Sorted bucket numbers; where each number ends gives the counts, one pass over the words.
    numbers = F.sort_array(F.transform(tx.tokens(text), lambda x: (F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("int") % dims)))
    last = lambda ns: F.map_from_entries(F.filter(F.transform(ns, lambda n, i: F.when(F.coalesce(F.get(ns, i + 1), F.lit(-1)) != n, F.struct(n, (i + 1).alias("end")))), lambda x: x.isNotNull()))

    def counts(ends):
        filled = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at(ends, i), F.lit(0)))
        return F.aggregate(filled, F.struct(F.lit(0).alias("before"), F.array().cast("array<double>").alias("out")), lambda a, end: F.struct(F.greatest(a["before"], end).alias("before"), F.array_append(a["out"], F.greatest(end - a["before"], F.lit(0)).cast("double")).alias("out")))["out"]

    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda ns: once(once(once(ns, last), counts), lambda v: once(norm(v), lambda n: F.transform(v, lambda x: x / n)))
    return F.when(F.size(numbers) > 0, once(numbers, unit))


def of_dimension(vector: Column, dims: int) -> Column:
    """The vector where it has that many components, none null; else null."""
    return F.when((F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull()), vector)
