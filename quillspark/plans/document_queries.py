"""Converted documents: nested blocks, tables on pages and across them, tokens of a vocabulary."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions import bpe
from quillspark.operators import chunks as ch, tables as tb
from quillspark.operators.lineage import shared_folder
from quillspark.operators.stored import StoredTable
from quillspark.plans.registry import query, table
from quillspark.sources import fetch, index as ix


def _nested(spark, d):
    """Documents as nested blocks: lines, and in them what stands between full stops."""
    block = lambda kind, text, *inner: F.struct(F.lit(kind).alias("type"), text.alias("text"), *inner)
    parts = lambda line: F.transform(F.split(line, "[.]"), lambda s: block("part", s)).alias("children")
    lines = F.transform(F.split("text", "\n"), lambda line: block("line", line, parts(line)))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.to_json(F.struct(F.lit("document").alias("type"), lines.alias("children"))).alias("json"))


@query("""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, i, unnest(range(len(x))) AS j, unnest(x) AS part FROM (SELECT doc_id, i, string_split(line, '.') AS x FROM l))
SELECT doc_id, '' AS path, 0 AS depth, 'document' AS type, NULL AS text_md5 FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, i::VARCHAR, 1, 'line', md5(line) FROM l UNION ALL SELECT doc_id, i || ',' || j, 2, 'part', md5(part) FROM p""")
def nested_nodes(spark, d):
    found = tb.nodes(_nested(spark, d), "doc_id")
    return found.select("doc_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), "depth", "type", F.md5("text").alias("text_md5"))


_READINGS = """a AS (SELECT conv_id AS page, turn AS id, (turn * 7)::DOUBLE AS x1, (length(text) % 50)::DOUBLE AS y1, (turn * 7 + 5 + length(text) % 11)::DOUBLE AS x2, (length(text) % 50 + 20)::DOUBLE AS y2 FROM conversations),
b AS (SELECT conv_id AS page, turn AS id, (turn * 7 + 1)::DOUBLE AS x1, (length(text) % 50 + length(role) - 4)::DOUBLE AS y1, (turn * 7 + 6 + length(text) % 11)::DOUBLE AS x2, (length(text) % 50 + 22)::DOUBLE AS y2 FROM conversations)"""


def _readings(spark, d):
    """Two readings of the boxes on pages: conversations as pages, turns as boxes."""
    n, t, r = F.length("text"), F.col("turn"), F.length("role")
    box = lambda x1, y1, x2, y2: F.struct(*[c.cast("double").alias(k) for k, c in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)])
    rows = table(spark, d, "conversations")
    first = rows.select(F.col("conv_id").alias("page"), t.alias("id"), box(t * 7, n % 50, t * 7 + 5 + n % 11, n % 50 + 20).alias("bbox"))
    return first, rows.select(F.col("conv_id").alias("page"), t.alias("id"), box(t * 7 + 1, n % 50 + r - 4, t * 7 + 6 + n % 11, n % 50 + 22).alias("bbox"))


_IOU = """greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s"""


@query(f"""WITH {_READINGS}, p AS (SELECT a.page, a.id, b.id AS other, {_IOU} FROM a JOIN b USING (page)),
m AS (SELECT page, id, arg_max(other, (i / (s - i), -other)) AS match_id, max(i / (s - i)) AS iou FROM p WHERE i / (s - i) > 0.5 GROUP BY page, id)
SELECT a.page, a.id, m.iou IS NOT NULL AS confirmed, m.match_id, round(m.iou, 6) AS iou FROM a LEFT JOIN m USING (page, id)""")
def cross_validated_tables(spark, d):
    first, second = _readings(spark, d)
    return tb.cross_validated(first, second, 0.5).withColumn("iou", F.round("iou", 6))


@query(f"""WITH {_READINGS} SELECT page, left_id, right_id, round(i / (s - i), 6) AS iou FROM (SELECT a.page, a.id AS left_id, b.id AS right_id, {_IOU} FROM a JOIN b USING (page)) WHERE i / (s - i) > 0.05""")
def box_pairs(spark, d):
    first, second = _readings(spark, d)
    return tb.overlapping(first, second, 0.05).withColumn("iou", F.round("iou", 6))


def _tables(spark, d):
    """Tables of documents: a conversation's turns, three to a page, with a text block above some."""
    n, t = F.length("text"), F.col("turn")
    rows = table(spark, d, "conversations").where("text is not null")
    box = lambda y1, y2: F.struct(F.lit(0.0).alias("x1"), y1.cast("double").alias("y1"), F.lit(100.0).alias("x2"), y2.cast("double").alias("y2"))
    cell = F.when(n % 3 == 0, F.lit("1.5")).when(n % 3 == 1, F.lit("12")).otherwise(F.lit("yes"))
    line = F.array(F.lit("4"), cell)
    page, top = F.floor(t / 3).cast("int"), (t % 3) * 100
    found = rows.select(
        F.col("conv_id").alias("doc_id"), t.alias("table_id"), page.alias("page"), box(top + 20, top + 40 + n % 60).alias("bbox"), F.array(F.lit("n"), F.col("role")).alias("header"),
        F.array_repeat(line, (n % 4 + 1).cast("int")).alias("cells"), F.lit(10.0).alias("content_top"), F.lit(300.0).alias("content_bottom"), F.lit(30.0).alias("margin_top"), F.lit(280.0).alias("margin_bottom"),
    )
    texts = rows.where(n % 5 == 0).select(F.col("conv_id").alias("doc_id"), page.alias("page"), box(top + 10, top + 15).alias("bbox"), F.when(n % 2 == 0, "between").otherwise(" ").alias("content"))
    return found, texts


@query("""WITH t AS (SELECT conv_id AS doc_id, turn AS table_id, turn // 3 AS page, (turn % 3) * 100 + 20 AS y1, (turn % 3) * 100 + 40 + length(text) % 60 AS y2, role, length(text) % 4 + 1 AS n,
  CASE length(text) % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'whole' ELSE 'truth' END AS kind, (length(text) % 5 = 0)::INT AS block, (length(text) % 5 = 0 AND length(text) % 2 = 0)::INT AS solid FROM conversations WHERE text IS NOT NULL),
x AS (SELECT *, lead(page) OVER w AS page2, lead(y1) OVER w AS y12, lead(role) OVER w AS role2, lead(n) OVER w AS n2, lead(kind) OVER w AS kind2, lead(block) OVER w AS block2, lead(solid) OVER w AS solid2 FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY table_id))
SELECT doc_id, table_id, kind, coalesce(role = role2 AND (n = 1 OR (kind = kind2 AND abs(n - n2) / greatest(n, n2) <= 0.5))
  AND CASE WHEN page = page2 THEN block2 = 0 OR (solid2 = 0 AND abs(y12 - y2) < 0.1 * 290) ELSE abs(y12 - 10) < 50 OR true END, false) AS continues FROM x""")
def continuing_tables(spark, d):
    """Which tables go on in the next one: headers, kinds of columns, rows, text between, pages."""
    found = tb.continuing(*_tables(spark, d), near=0.1)
    return found.select("doc_id", "table_id", F.element_at("kinds", 2).alias("kind"), "continues")


@query()
def merged_typed_tables(spark, d):
    found = tb.continuing(*_tables(spark, d), near=0.1)
    return tb.merge_adjacent(found, continues="continues")


@query()
def text_without_tables(spark, d):
    """Turns less those that all but repeat their conversation's first answer, taken as a table's text."""
    rows = table(spark, d, "conversations").select(F.lit(0).alias("doc_id"), F.col("conv_id").alias("page"), F.col("turn").alias("block_id"), "role", F.col("text").alias("content"))
    first = rows.where("role = 'assistant'").groupBy("doc_id", "page").agg(F.min_by("content", "block_id").alias("table_text"))
    return tb.without_similar_text(rows, first, 80.0).select("page", "block_id")


@query("""WITH r AS (SELECT page_id, url, html, CASE WHEN page_id % 7 = 0 THEN 404 WHEN page_id % 13 = 0 THEN NULL ELSE 200 END AS s, CASE WHEN page_id % 5 = 0 THEN 'x' WHEN page_id % 5 = 1 THEN '' || strlen(html) END AS len, page_id % 11 = 0 AS there FROM pages),
o AS (SELECT *, CASE WHEN there THEN 'File exists and force=False' WHEN s IS NULL THEN 'timed out' WHEN s <> 200 THEN 'HTTP error 404 for URL: ' || url
  WHEN try_cast(len AS BIGINT) > 6000 THEN 'Content-Length ' || len || ' exceeds max_size 6000' WHEN strlen(html) > 6000 THEN 'Downloaded content size ' || strlen(html) || ' exceeds max_size 6000' END AS error_message FROM r)
SELECT page_id, CASE WHEN there THEN 'skipped' WHEN error_message IS NULL THEN 'success' ELSE 'failed_request' END AS fetch_status, error_message,
  CASE WHEN error_message IS NULL THEN md5(html) END AS content_md5, CASE WHEN error_message IS NULL THEN strlen(html) END AS size FROM o""")
def fetched_pages(spark, d):
    """Pages as recorded responses, with refusals, limits and files that exist."""
    n = F.col("page_id")
    rows = table(spark, d, "pages").select(
        "page_id", "url", F.when(n % 7 == 0, 404).when(n % 13 == 0, None).otherwise(200).alias("http_status"), F.when(n % 5 == 0, "x").when(n % 5 == 1, F.octet_length("html").cast("string")).alias("content_length"),
        F.encode("html", "UTF-8").alias("body"), F.when((n % 13 == 0) & (n % 7 != 0), "timed out").alias("error"),
    )
    return fetch.outcome(rows, 6000, n % 11 == 0).select("page_id", "fetch_status", "error_message", "content_md5", "size")


@query("""WITH t AS (SELECT conv_id, turn, text, length(text) % 4 AS odd, (length(text) % 100)::DOUBLE AS acc FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, round(0.4 * (acc / 100) * CASE WHEN odd = 1 THEN 0.8 ELSE 1 END + 0.3 * CASE WHEN odd = 2 THEN 5 / 6 ELSE 1 END + 0.3 * CASE WHEN odd = 3 THEN 0 ELSE 1 END, 6) AS quality FROM t""")
def table_quality(spark, d):
    n = F.length("text")
    line = lambda *cells: F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells])
    last = F.when(n % 4 == 1, line("x", "a")).when(n % 4 == 2, line(" ", "b")).when(n % 4 == 3, line("3")).otherwise(line("3", "c"))
    rows = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", line("n", "name").alias("header"), F.array(line("1", "a"), line("2.5", "b"), last).alias("cells"), (n % 100).cast("double").alias("accuracy"))
    return tb.quality(rows).select("conv_id", "turn", F.round("quality", 6).alias("quality"))


@query("""SELECT CASE WHEN contains(url, '#') THEN 'malformed' WHEN contains(url, '/de/') THEN 'invalid' WHEN contains(url, '.net') THEN 'not saved' WHEN contains(url, '?') THEN 'not searchable' ELSE 'searchable' END AS kind, count(*) AS n FROM pages GROUP BY kind""")
def index_scan_jsonl(spark, d):
    """The pages' index, appended as JSON lines to the shared folder and read back, broken lines and odd statuses included."""
    u = lambda part: F.contains("url", F.lit(part))
    record = F.to_json(
        F.struct(
            F.col("url").alias("original_url"),
            F.when(u("?"), "a.css").otherwise("a.HTML").alias("local_path"),
            F.when(u("/de/"), "odd").when(u(".net"), "failed_request").otherwise("success").alias("fetch_status"),
        )
    )
    path = f"{shared_folder(spark)}/quillspark-index-lines/{uuid.uuid4().hex}"
    table(spark, d, "pages").select(F.when(u("#"), F.concat(F.lit('{"original_url": '), "url")).otherwise(record).alias("value")).write.text(path)
    return ix.scan_report(ix.read_index(spark, path))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS r, count(*) OVER (PARTITION BY text) AS copies FROM documents)
SELECT md5(text) AS section_id, doc_id AS last, source, copies > 1 AS replaced FROM n WHERE r = 1""")
def stored_upsert(spark, d):
    """Sections of all documents in a stored table: each section's first document, then, by key, its last one."""
    rows = table(spark, d, "documents").where("text is not null").select(F.md5("text").alias("section_id"), F.col("doc_id").alias("last"), "source")
    folder = f"{shared_folder(spark)}/quillspark-tables/{uuid.uuid4().hex}"
    stored_ = StoredTable.create(spark, folder, "section_id string, last long, source string", "section_id", 16)
    first = stored_.upsert(rows.withColumn("back", -F.col("last")), order="back", stream="sections", batch=0)
    stored_.upsert(rows, order="last", stream="sections", batch=1)
    stored_.upsert(rows.withColumn("source", F.lit("repeated")), order="last", stream="sections", batch=1)
    before = stored_.read(first).select("section_id", F.col("last").alias("was"))
    return stored_.read().join(before, "section_id").select("section_id", "last", "source", (F.col("last") != F.col("was")).alias("replaced"))


@query()
def bpe_token_counts(spark, d):
    """Tokens of each text by a byte-level vocabulary."""
    return table(spark, d, "documents").select("doc_id", bpe.count(F.col("text"), bpe.Vocabulary()).alias("n_tokens"))


@query()
def sentence_packing_bpe(spark, d):
    """Sentences packed to 60 tokens of a vocabulary."""
    return ch.packed(table(spark, d, "documents"), "doc_id", most=60, vocabulary=bpe.Vocabulary()).select("doc_id", "ordinal", "n_tokens", "section_id")
