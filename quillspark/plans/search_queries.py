"""Searches over documents, vectors and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import pages as pg, postings as po, search as se, vectors as ve
from quillspark.plans.data_queries import _CANON, _PATH
from quillspark.plans.registry import LESSONS, lessons, query, table, words_sql

TERMS = "apache license version mit"
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _index(spark, d) -> po.Index:
    """The stored index of the documents' texts: built by the first search of a table, then read."""
    return po.ensure(spark, f"{d}/documents.parquet")


def _bm25_sql(terms: str, source: str, limit: int, offset: int, threshold: float, where: str = "true", name: str = "score") -> str:
    """BM25 as SQL over a source with doc_id, text and tags."""
    want = "[" + ", ".join(f"'{t}'" for t in sorted(set(terms.split()))) + "]"
    return f"""
  words AS (SELECT doc_id, tags, {words_sql('text')} AS w FROM {source}),
  stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
  tf AS (SELECT doc_id, tags, len(w) AS dl, t, len(list_filter(w, lambda x: x = t)) AS tf FROM words, (SELECT unnest({want}) AS t)),
  df AS (SELECT t, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY t),
  scored AS (
    SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
    FROM tf JOIN df USING (t), stats WHERE {where} GROUP BY doc_id HAVING sum(tf) > 0),
  hits AS (SELECT doc_id, score FROM scored WHERE score >= {threshold}),
  ranked AS (SELECT doc_id, score AS {name}, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM hits),
  bm AS (SELECT * FROM ranked WHERE rank > {offset} AND rank <= {limit + offset})"""


@query(f"WITH {LESSONS}, {_bm25_sql(TERMS, 'lessons', 10, 0, 0.1)} SELECT doc_id, round(score, 6) AS score, rank::INTEGER AS rank, total FROM bm")
def bm25_search(spark, d):
    return po.bm25(_index(spark, d), TERMS, limit=10).withColumn("score", F.round("score", 6))


@query(f"WITH {LESSONS}, {_bm25_sql('the license', 'lessons', 5, 3, 0.1, where='''list_contains(tags, 'en')''')} SELECT doc_id, round(score, 6) AS score, rank::INTEGER AS rank, total FROM bm")
def bm25_tagged_page(spark, d):
    tagged = lessons(spark, d).where(tx.has_all_tags(F.col("tags"), ["en"]))
    return po.bm25(_index(spark, d), "the license", limit=5, offset=3, allowed=tagged).withColumn("score", F.round("score", 6))


@query(f"WITH {LESSONS}, {_bm25_sql(TERMS, 'lessons', 10, 0, 0.1)} SELECT doc_id, round(score, 6) AS score, rank::INTEGER AS rank, total FROM bm")
def bm25_scan(spark, d):
    """Without an index: one pass over all texts."""
    return se.bm25(table(spark, d, "documents"), TERMS, limit=10).withColumn("score", F.round("score", 6))


@query(f"WITH {LESSONS}, {_bm25_sql('mit license granted', 'lessons', 25, 0, 0.0)} SELECT doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM bm")
def bm25_best(spark, d):
    """The best alone, from the bands of postings that they need."""
    return po.best(_index(spark, d), "mit license granted", 25)[0].withColumn("score", F.round("score", 6))


@query(f"""WITH w AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
n AS (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license')) AS n FROM w)
SELECT doc_id, n::BIGINT AS n FROM n WHERE n > 0""")
def phrase_search(spark, d):
    return po.phrase(po.ensure(spark, f"{d}/documents.parquet", positions=True), "MIT License")


@query()
def stemmed_search(spark, d):
    return po.bm25(_index(spark, d), "licensing granted works", limit=20, stemmed=True).withColumn("score", F.round("score", 6))


@query(f"""WITH t AS (SELECT doc_id, unnest({words_sql('text')}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term""")
def index_dictionary(spark, d):
    """Every term of the stored index with its document frequency."""
    index = _index(spark, d)
    return spark.read.parquet(f"{index.folder}/terms").select("term", "df")


@query(f"""WITH {LESSONS}, {_bm25_sql(TERMS, 'lessons', 4, 2, 0.1)}
SELECT list({{'rank': rank::INTEGER, 'doc_id': doc_id, 'score': round(score, 6), 'problem': CASE WHEN length(problem) > 80 THEN substr(problem, 1, 80) || '...' ELSE problem END, 'tags': tags}} ORDER BY rank) AS results,
       max(total) AS total, 2 AS "offset", 4 AS "limit" FROM bm JOIN lessons USING (doc_id)""")
def search_envelope(spark, d):
    page = po.bm25(_index(spark, d), TERMS, limit=4, offset=2).withColumn("score", F.round("score", 6))
    total = po.scores(_index(spark, d), TERMS).where("score >= 0.1").agg(F.count("*").alias("total"))
    shown = se.previewed(page, lessons(spark, d), "doc_id", ["problem", "tags"], 80)
    return se.envelope(shown, total, 4, 2)


@query(f"""WITH hits AS (SELECT e.vec_id, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE {_COS} IS NOT NULL)
SELECT vec_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, vec_id)::INTEGER AS rank FROM hits ORDER BY s DESC, vec_id LIMIT 10""")
def semantic_indexed(spark, d):
    """Nearest vectors from the lists that can hold them."""
    index = ve.ensure(spark, f"{d}/embeddings.parquet")
    return index.nearest(_vector(spark, d, 7), 10)[0].withColumn("score", F.round("score", 6))


def _vector(spark, d, vec_id=0):
    row = table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])


@query(f"""WITH hits AS (SELECT e.vec_id, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_COS} >= 0.1)
SELECT vec_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, vec_id)::INTEGER AS rank, count(*) OVER () AS total FROM hits ORDER BY s DESC, vec_id LIMIT 10""")
def semantic_topk(spark, d):
    return se.semantic(table(spark, d, "embeddings"), _vector(spark, d), limit=10, threshold=0.1).withColumn("score", F.round("score", 6))


@query(f"""WITH hits AS (SELECT e.vec_id, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 AND {_COS} >= -1)
SELECT vec_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, vec_id)::INTEGER AS rank, count(*) OVER () AS total FROM hits ORDER BY s DESC, vec_id LIMIT 5""")
def semantic_tagged(spark, d):
    rows = table(spark, d, "embeddings").withColumn("tags", F.array(F.col("label").cast("string")))
    return se.semantic(rows, _vector(spark, d), tags=["3"], threshold=-1.0).withColumn("score", F.round("score", 6))


@query(f"""WITH {LESSONS}, {_bm25_sql(TERMS, 'lessons', 20, 0, 0.01)},
sem0 AS (SELECT e.vec_id AS doc_id, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_COS} >= 0.05),
sem AS (SELECT doc_id, s, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM sem0 ORDER BY s DESC, doc_id LIMIT 20),
f AS (SELECT coalesce(b.doc_id, s.doc_id) AS doc_id, coalesce(b.score, 0) AS bm25_score, coalesce(s.s, 0) AS similarity_score,
             coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.r), 0) AS h FROM bm b FULL JOIN sem s ON b.doc_id = s.doc_id)
SELECT doc_id, round(bm25_score, 6) AS bm25_score, round(similarity_score, 6) AS similarity_score, round(h, 8) AS hybrid_score,
       row_number() OVER (ORDER BY h DESC, doc_id)::INTEGER AS rank, count(*) OVER () AS total FROM f ORDER BY h DESC, doc_id LIMIT 10""")
def hybrid_search(spark, d):
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    words = po.bm25(_index(spark, d), TERMS, limit=20, threshold=0.01)
    out = se.fuse(words, se.semantic(vectors, _vector(spark, d), "doc_id", limit=20, threshold=0.05), "doc_id", 10)
    return out.withColumns({"bm25_score": F.round("bm25_score", 6), "similarity_score": F.round("similarity_score", 6), "hybrid_score": F.round("hybrid_score", 8)})


@query(f"""WITH {LESSONS}, hits AS (SELECT doc_id, len(list_intersect(tags, ['en'])) AS overlap FROM lessons
  WHERE (contains(lower(problem), 'that') OR contains(lower(solution), 'that') OR list_contains(tags, 'that')) AND list_has_all(tags, ['en']))
SELECT doc_id, overlap::INTEGER AS overlap, row_number() OVER (ORDER BY overlap DESC, doc_id)::INTEGER AS rank, count(*) OVER () AS total FROM hits ORDER BY overlap DESC, doc_id LIMIT 10""")
def keyword_search(spark, d):
    return se.keyword_search(lessons(spark, d), ["That"], ["problem", "solution"], tags=["en"])


@query(f"""WITH {LESSONS}, hits AS (SELECT doc_id, len(list_intersect(tags, ['license', 'mit'])) AS overlap FROM lessons
  WHERE (contains(lower(problem), 'license') OR contains(lower(solution), 'license')) AND (contains(lower(problem), 'mit') OR contains(lower(solution), 'mit')))
SELECT doc_id, overlap::INTEGER AS overlap, row_number() OVER (ORDER BY overlap DESC, doc_id)::INTEGER AS rank, count(*) OVER () AS total FROM hits ORDER BY overlap DESC, doc_id LIMIT 10""")
def keyword_search_all(spark, d):
    return se.keyword_search(lessons(spark, d), ["license", " MIT "], ["problem", "solution"], mode="AND")


@query(f"""WITH {LESSONS}, hits AS (SELECT doc_id, len(list_intersect(tags, ['de', 'src2', 'src5'])) AS overlap FROM lessons)
SELECT doc_id, overlap::INTEGER AS overlap, row_number() OVER (ORDER BY overlap DESC, doc_id)::INTEGER AS rank, count(*) OVER () AS total FROM hits WHERE overlap > 0 ORDER BY overlap DESC, doc_id LIMIT 20""")
def tag_search_any(spark, d):
    return se.tag_search(lessons(spark, d), ["de", "src2", "src5"], limit=20)


@query(f"""WITH {LESSONS}, hits AS (SELECT doc_id, len(list_intersect(tags, ['de', 'src4'])) AS overlap FROM lessons)
SELECT doc_id, overlap::INTEGER AS overlap, row_number() OVER (ORDER BY overlap DESC, doc_id)::INTEGER AS rank, count(*) OVER () AS total FROM hits WHERE overlap = 2 ORDER BY doc_id LIMIT 10""")
def tag_search_all(spark, d):
    return se.tag_search(lessons(spark, d), ["de", "src4"], mode="AND")


@query(f"""WITH {LESSONS}, {_bm25_sql('license version', 'lessons', 10**9, 0, 0.0)},
ok AS (SELECT doc_id FROM lessons WHERE list_has_all(tags, ['en']) AND (list_has_all({words_sql('problem')}, ['license', 'version']) OR list_has_all({words_sql('solution')}, ['license', 'version']))),
found AS (SELECT bm.doc_id, bm.score FROM bm SEMI JOIN ok ON bm.doc_id = ok.doc_id)
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank, count(*) OVER () AS total FROM found ORDER BY score DESC, doc_id LIMIT 10""")
def view_search(spark, d):
    return se.view_search(lessons(spark, d), "license version", ["problem", "solution"], tags=["en"]).withColumn("score", F.round("score", 6))


@query("""SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def newest_first(spark, d):
    rows = se.newest(table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_orderkey", "URGENT", "F", "o_orderstatus", 20)
    return rows.select("o_orderkey", "o_orderdate", "o_orderpriority")


@query("""WITH hits AS (SELECT doc_id, 11.0::DOUBLE / greatest(length(text), 1) AS r FROM documents WHERE contains(lower(text), 'mit license'))
SELECT doc_id, round(r, 8) AS relevance, row_number() OVER (ORDER BY r DESC, doc_id)::INTEGER AS rank, count(*) OVER () AS total FROM hits ORDER BY r DESC, doc_id LIMIT 10""")
def substring_relevance(spark, d):
    return se.substring_search(table(spark, d, "documents"), "MIT License").withColumn("relevance", F.round("relevance", 8))


@query(f"""WITH {LESSONS}, hits AS (SELECT doc_id, len(list_intersect(tags, ['fr', 'src7'])) AS matches FROM lessons)
SELECT doc_id, matches::INTEGER AS matches, row_number() OVER (ORDER BY matches DESC, doc_id)::INTEGER AS rank, count(*) OVER () AS total FROM hits WHERE matches > 0 ORDER BY matches DESC, doc_id LIMIT 10""")
def fuzzy_tag_search(spark, d):
    return se.fuzzy_tags(lessons(spark, d), ["fr", "src7"])


@query(f"""WITH {LESSONS}, hits AS (SELECT doc_id, (CASE WHEN contains(lower(problem), 'that') OR contains(lower(solution), 'that') THEN 100 ELSE 0 END
  + CASE WHEN contains(lower(problem), 'licensed') OR contains(lower(solution), 'licensed') THEN 100 ELSE 0 END)::DOUBLE AS score FROM lessons)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank, count(*) OVER () AS total FROM hits WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def fuzzy_text_search(spark, d):
    return se.fuzzy_text(lessons(spark, d), ["that", "licensed"], ["problem", "solution"])


@query("""SELECT doc_id, (lower(text) LIKE '%the_%' AND lower(text) LIKE '%license%') AS like_hit,
       (contains(lower(text), 'the') AND contains(lower(text), 'of')) AS all_keywords,
       round((contains(lower(text), 'the')::INTEGER + contains(lower(text), 'license')::INTEGER) / 3.0::DOUBLE, 6) AS fraction FROM documents""")
def keyword_predicates(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        (tx.like_any([t], "the_") & tx.like_any([t], "license")).alias("like_hit"),
        tx.contains_all(t, ["The", " ", "of"]).alias("all_keywords"),
        F.round(tx.keyword_fraction(t, ["the", "license", "the"]), 6).alias("fraction"),
    )


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<h1[^>]*>([^<]*)</h1>', 1)) AS h FROM pages)
SELECT page_id, trim(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS snippet FROM t WHERE trim(h) <> ''""")
def select_headings(spark, d):
    found = pg.extract(table(spark, d, "pages"), "h1")
    return found.select("page_id", F.explode("snippets").alias("snippet"))


# The pages' markup is simple enough for patterns: no element stands in another of its kind.
_TEXT = """regexp_replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g')"""
_ARTICLE = """regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), '<[^>]*>', ' ', 'g')"""
_PAGE_TEXT = "nullif(trim(" + _TEXT.format(f"regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) || ' ' || {_ARTICLE}") + "), '')"
_LINKS = "list_filter(list_transform(regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a>', 1), lambda x: trim(" + _TEXT.format("x") + ")), lambda x: x <> '')"
_H1 = "trim(" + _TEXT.format("regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)") + ")"


@query(f"""WITH {_CANON}, t AS (SELECT page_id, url AS original_url, {_PATH} AS local_path, {_PAGE_TEXT} AS page_text, {_LINKS} AS links, trim({_TEXT.format(_ARTICLE)}) AS article, {_H1} AS h1 FROM addr),
c AS (SELECT page_id, original_url, local_path, array_to_string(list_filter(links || [article, h1], lambda x: x <> ''), ' ... ') AS content FROM t WHERE contains(lower(page_text), 'the'))
SELECT page_id, original_url, local_path, CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END AS content_preview, 'article, li > a, h1' AS selector_matched FROM c ORDER BY page_id LIMIT 25""")
def page_search(spark, d):
    return pg.search(table(spark, d, "pages"), ["the"], "article, li > a, h1", limit=25)


@query(f"SELECT page_id, {_PAGE_TEXT} AS page_text FROM pages")
def page_text(spark, d):
    from quillspark.functions.html import page_text_udf

    return table(spark, d, "pages").select("page_id", page_text_udf("html").alias("page_text"))


@query()
def page_blocks(spark, d):
    return pg.blocks(table(spark, d, "pages").select("page_id", "html")).select("page_id", "ordinal", "type", "content", "block_type", "start_line", "end_line")


@query()
def advanced_block_search(spark, d):
    rows = pg.blocks(table(spark, d, "documents").select("doc_id", "text"), "text", "markdown")
    return pg.block_search(rows, ["licensed", "under"], "doc_id", limit=20)
