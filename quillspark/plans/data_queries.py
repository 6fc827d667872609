"""Addresses, index, store, graph, JSON, chunks, tables, jobs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import jsontext as jx, markdown as mx, text as tx, times, urls
from quillspark.functions.markdown import pack
from quillspark.operators import chunks as ch, graph as gr, pages as pg, search as se, store as st, tables as tb
from quillspark.plans.registry import LESSONS, lessons, query, table
from quillspark.sources import files as fs, index as ix
from quillspark.streaming import jobs

# Canonical addresses in SQL; the driver's pages have no %-escapes beyond ASCII.
_CANON = """canon AS (
  SELECT page_id, url, html,
         lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
         lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host0,
         url_decode(replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)', 1), '+', '%2B')) AS path0
  FROM (SELECT *, CASE WHEN trim(url) LIKE '//%' THEN 'http:' || trim(url) WHEN regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://') THEN trim(url) ELSE 'http://' || trim(url) END AS u FROM pages)),
addr AS (
  SELECT page_id, url, html, host, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END AS canonical_url
  FROM (SELECT *, CASE WHEN scheme = 'http' THEN regexp_replace(host0, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host0, ':443$', '') ELSE host0 END AS host, rtrim(path0, '/') AS path FROM canon))"""
# A file's place, without regular expressions for the suffix: the last piece after a dot of the last piece after a slash.
_LAST = "list_last(string_split(regexp_replace(split_part(split_part(split_part(url, '#', 1), '?', 1), ';', 1), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/'))"
_DOTTED = f"CASE WHEN ltrim({_LAST}, '.') LIKE '%.%' THEN '.' || lower(list_last(string_split({_LAST}, '.'))) END"
_SUFFIX = f"""CASE WHEN {_DOTTED} IN ('.html', '.htm', '.txt', '.js', '.css', '.json', '.xml', '.md', '.rst', '.pdf', '.png', '.jpg', '.jpeg', '.gif', '.svg', '.webp', '.ico', '.woff', '.woff2', '.ttf', '.otf', '.eot', '.yaml', '.yml')
  THEN {_DOTTED} ELSE '.html' END"""
_HOST = "rtrim(regexp_replace(list_last(string_split(host, '@')), ':[0-9]*$', ''), '.')"
_NAME = "substr(regexp_replace(regexp_replace(canonical_url, '^[a-z]+://', ''), '[^A-Za-z0-9_-]+', '_', 'g'), 1, 100)"
_PATH = f"{_HOST} || '/' || {_NAME} || '-' || substr(sha256(canonical_url), 1, 8) || {_SUFFIX}"


@query(f"WITH {_CANON} SELECT page_id, canonical_url, md5(canonical_url) AS download_id, {_PATH} AS local_path, md5(html) AS content_md5, sha256(html) AS content_sha256 FROM addr")
def canonical_addresses(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.canonical(u).alias("canonical_url"), urls.download_id(u).alias("download_id"), urls.local_path(u).alias("local_path"), F.md5("html").alias("content_md5"), F.sha2("html", 256).alias("content_sha256"))


# Every page's address, and the same path at hosts that must be refused or admitted.
_HOSTS = ["", "x@127.0.0.1", "u:p@localhost", "localhost.", "2130706433", "0x7f.1", "127.1", "10.0.0.8:8080", "[::1]", "wiki.internal", "8.8.8.8", "me@8.8.8.8:80"]


@query(f"""WITH forms AS (SELECT unnest({_HOSTS!r}) AS form),
h AS (SELECT page_id, form, url, CASE WHEN form = '' THEN lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1)) ELSE form END AS netloc FROM pages, forms),
n AS (SELECT *, rtrim(regexp_replace(list_last(string_split(netloc, '@')), ':[0-9]*$', ''), '.') AS host FROM h),
o AS (SELECT *, string_split(host, '.') AS labels FROM n)
SELECT page_id, form, CASE WHEN host = '' OR list_last(labels) IN ('localhost', 'local', 'internal', 'test', 'example', 'invalid', 'lan') OR host LIKE '%home.arpa' OR host = '[::1]'
    OR (list_last(labels) SIMILAR TO '0x[0-9a-f]*|[0-9]+' AND (len(labels) <> 4 OR labels[1] IN ('0', '10', '127'))) THEN 'failed_ssrf'
  WHEN host <> (SELECT min(host) FROM n WHERE form = '' AND host <> '') THEN 'skipped_domain' WHEN contains(url, '?') THEN 'failed_robotstxt' ELSE 'admitted' END AS status FROM o""")
def link_admission(spark, d):
    pages = table(spark, d, "pages")
    start = pages.select(urls.host_of(F.col("url")).alias("h")).where("h <> ''").agg(F.min("h")).first()[0]
    forms = pages.select("page_id", "url", F.explode(F.array(*[F.lit(h) for h in _HOSTS])).alias("form"))
    url = F.when(F.col("form") == "", F.col("url")).otherwise(F.concat(F.lit("http://"), F.col("form"), F.lit("/")))
    return forms.select("page_id", "form", urls.admission(url, start, ~F.contains("url", F.lit("?")), F.lit(True)).alias("status"))


@query(f"""WITH {_CANON}, r AS (SELECT *, contains(url, '.net') AS failed FROM addr)
SELECT url AS original_url, canonical_url, CASE WHEN failed THEN '' ELSE {_PATH} END AS local_path, CASE WHEN NOT failed THEN md5(html) END AS content_md5, CASE WHEN failed THEN 'failed_request' ELSE 'success' END AS fetch_status FROM r""")
def index_records(spark, d):
    pages = table(spark, d, "pages").withColumn("fetch_status", F.when(F.contains("url", F.lit(".net")), "no such status").otherwise("success"))
    return ix.records(pages).select("original_url", "canonical_url", "local_path", "content_md5", "fetch_status")


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(url, '#') THEN 'malformed' WHEN contains(url, '.net') THEN 'not saved' WHEN contains(url, '?') THEN 'not searchable' ELSE 'searchable' END AS kind FROM pages) GROUP BY kind""")
def index_scan_report(spark, d):
    p = table(spark, d, "pages")
    rows = p.select(
        F.when(F.contains("url", F.lit(".net")), "failed_request").otherwise("success").alias("fetch_status"),
        F.when(F.contains("url", F.lit("?")), "a.css").otherwise("a.HTML").alias("local_path"),
        F.when(F.contains("url", F.lit("#")), "{").alias("_corrupt_record"),
    )
    return ix.scan_report(rows)


@query("""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS href FROM pages)
SELECT count(*) AS n_links, count(DISTINCT href) AS n_targets FROM (SELECT DISTINCT page_id, href FROM a WHERE href <> '' AND NOT regexp_matches(lower(href), '^(#|javascript:|mailto:|tel:)'))""")
def link_extraction(spark, d):
    from quillspark.functions.html import links_udf

    rows = table(spark, d, "pages").select("page_id", F.explode(links_udf("html")).alias("href")).where(urls.followable(F.col("href"))).distinct()
    return rows.agg(F.count("*").alias("n_links"), F.count_distinct("href").alias("n_targets"))


@query(f"""WITH {_CANON}, l AS (SELECT DISTINCT url AS src, scheme, host, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS href FROM addr JOIN (SELECT page_id, scheme FROM canon) USING (page_id)),
t AS (SELECT src, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END AS dst FROM (SELECT *, rtrim(url_decode(replace(split_part(split_part(split_part(href, '#', 1), '?', 1), ';', 1), '+', '%2B')), '/') AS path FROM l WHERE href LIKE '/%'))
SELECT DISTINCT src, dst FROM t WHERE dst NOT IN (SELECT canonical_url FROM addr)""")
def page_links(spark, d):
    p = table(spark, d, "pages")
    return pg.same_site(pg.links(p), p.select(urls.canonical(F.col("url")).alias("url")))


# The store: orders as a keyed table, changed rows from the same table.
@query("""WITH changes AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_orderkey + 10000000, 'N', 1.0 FROM orders WHERE o_orderpriority = '5-LOW')
SELECT o_orderkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changes)
UNION ALL SELECT o_orderkey, o_orderstatus, round(o_totalprice, 4) FROM changes""")
def upsert_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    changes = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    new = o.where("o_orderpriority = '5-LOW'").select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))
    return st.upsert(o.drop("o_orderpriority"), changes.unionAll(new), "o_orderkey", "o_totalprice").withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders""")
def partial_update(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changes = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("done").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"))
    return st.update(o, changes, "o_orderkey")


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer
UNION ALL SELECT c_custkey + 10000000, c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def insert_validated(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows = c.select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "  ").otherwise(F.col("c_name")).alias("c_name"), "c_mktsegment")
    return st.insert(c, rows, ("c_name", "c_mktsegment"), key="none", time_col="none")


@query("""SELECT p_partkey, p_brand AS brand, CASE WHEN p_size > 25 THEN NULL ELSE p_type END AS kind, CASE WHEN p_size > 25 THEN 'big' END AS size FROM part""")
def merge_attributes(spark, d):
    part = table(spark, d, "part")
    p = part.select("p_partkey", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type")).alias("attrs"))
    changes = part.where("p_size > 25").select("p_partkey", F.create_map(F.lit("kind"), F.lit(None).cast("string"), F.lit("size"), F.lit("big"), F.lit("_key"), F.lit("no")).alias("attrs"))
    out = st.merge(p, changes, "p_partkey")
    return out.select("p_partkey", F.col("attrs")["brand"].alias("brand"), F.col("attrs")["kind"].alias("kind"), F.col("attrs")["size"].alias("size"))


@query("""WITH e AS (SELECT o_orderkey AS edge_id, o_custkey AS a, o_orderkey % 1500 AS b FROM orders), gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT edge_id, a, b FROM e WHERE a NOT IN (FROM gone) AND b NOT IN (FROM gone)""")
def cascade_delete(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1500).alias("b"))
    return st.cascade(e, table(spark, d, "customer").where("c_acctbal < 0"), "c_custkey", "a", "b")


@query("""SELECT c_custkey FROM customer WHERE c_acctbal >= 0""")
def delete_rows(spark, d):
    customers = table(spark, d, "customer")
    c = customers.select("c_custkey")
    return st.delete(c, customers.where("c_acctbal < 0").select("c_custkey").unionAll(c.select(F.col("c_custkey") + 10**9)), "c_custkey")


@query("""SELECT c_custkey, 'customer/' || c_custkey AS "_from", 'nation/' || c_nationkey AS "_to", c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'MACHINERY'""")
def insert_edge(spark, d):
    c = table(spark, d, "customer")
    base = {"_from": F.concat(F.lit("customer/"), "c_custkey"), "_to": F.concat(F.lit("nation/"), "c_nationkey")}
    free = F.create_map(F.lit("_from"), F.lit("forged"), F.lit("segment"), F.col("c_mktsegment"))
    rows = c.select("c_custkey", st.edge_attributes(free, base).alias("attrs"), F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise("lives in").alias("rationale"), F.lit("RELATED").alias("type"))
    good = st.insert_edges(rows.limit(0), rows)
    return good.select("c_custkey", F.col("attrs")["_from"].alias("_from"), F.col("attrs")["_to"].alias("_to"), F.col("attrs")["segment"].alias("segment"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, min(ts) AS start_time, max(ts) AS last_time, count(*) AS n_events FROM events GROUP BY user_id""")
def job_states(spark, d):
    e = table(spark, d, "events")
    return jobs.job_states(e, "user_id", "event_type")


@query("""SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, d):
    return jobs.windowed(table(spark, d, "events"))


@query("""WITH ok AS (SELECT * FROM (VALUES ('', 'pending'), ('pending', 'running'), ('running', 'completed'), ('running', 'failed'), ('completed', 'pending'), ('failed', 'pending')) t(a, b)),
e AS (SELECT event_id, user_id, ts, ['pending', 'running', 'completed'][1 + (event_id % 3)] AS status FROM events),
s AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS before FROM e)
SELECT event_id, status FROM s WHERE NOT EXISTS (SELECT 1 FROM ok WHERE a = before AND b = status)""")
def refused_transitions(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.element_at(F.array(F.lit("pending"), F.lit("running"), F.lit("completed")), (F.col("event_id") % 3 + 1).cast("int")).alias("status"))
    return jobs.refused(e, "user_id", "status", "ts", "event_id").select("event_id", "status")


# A star graph: customer -> nation -> region, and customers of one nation in a chain.
_EDGES = """edges AS (
  SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, c_custkey AS edge_id FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1000000 + n_nationkey FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'n' || (r_regionkey * 2), 2000000 + r_regionkey FROM region)"""


def _edges(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.col("c_custkey").cast("long").alias("edge_id"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), (F.col("n_nationkey") + 1000000).cast("long"))
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("n"), F.col("r_regionkey") * 2), (F.col("r_regionkey") + 2000000).cast("long"))
    return c.unionAll(n).unionAll(r)


@query(f"""WITH RECURSIVE {_EDGES}, walk AS (
  SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS vertex, 0 AS depth, []::BIGINT[] AS path FROM customer
  UNION ALL SELECT w.start, e.dst, w.depth + 1, list_append(w.path, e.edge_id) FROM walk w JOIN edges e ON e.src = w.vertex WHERE w.depth < 4 AND NOT list_contains(w.path, e.edge_id))
SELECT start, vertex, path[-1] AS edge, depth, path FROM walk""")
def traverse_outbound(spark, d):
    starts = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("start"))
    return gr.traverse(_edges(spark, d), starts, 0, 4)


@query(f"""WITH RECURSIVE {_EDGES}, both_ways AS (SELECT src, dst, edge_id FROM edges UNION ALL SELECT dst, src, edge_id FROM edges WHERE src <> dst), walk AS (
  SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS vertex, 0 AS depth, []::BIGINT[] AS path FROM region
  UNION ALL SELECT w.start, e.dst, w.depth + 1, list_append(w.path, e.edge_id) FROM walk w JOIN both_ways e ON e.src = w.vertex WHERE w.depth < 3 AND NOT list_contains(w.path, e.edge_id))
SELECT start, vertex, path[-1] AS edge, depth, path FROM walk WHERE depth >= 1""")
def traverse_any(spark, d):
    starts = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("start"))
    return gr.traverse(_edges(spark, d), starts, 1, 3, "ANY")


@query(f"""WITH RECURSIVE {_EDGES}, page AS (SELECT url, CASE WHEN url IN ('n3', 'r2') THEN 'failed_robotstxt' ELSE 'success' END AS status FROM (SELECT src AS url FROM edges UNION SELECT dst FROM edges WHERE dst <> 'n8')),
walk AS (SELECT 'c' || c_custkey AS url, 0 AS depth FROM customer
  UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN page p ON p.url = w.url AND p.status = 'success' JOIN edges e ON e.src = w.url WHERE w.depth < 3)
SELECT w.url, min(w.depth)::INTEGER AS depth, coalesce(any_value(p.status), 'failed_request') AS status FROM walk w LEFT JOIN page p ON p.url = w.url GROUP BY w.url""")
def crawl_breadth_first(spark, d):
    e = _edges(spark, d)
    known = e.select(F.col("src").alias("url")).union(e.where("dst <> 'n8'").select("dst")).distinct()
    page = known.withColumn("status", F.when(F.col("url").isin("n3", "r2"), "failed_robotstxt").otherwise("success"))
    seeds = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("url"))
    return gr.crawl(page, e, seeds, 3)


@query("""SELECT event_id, true AS json_like, (props::JSON ->> 'k')::BIGINT AS k, contains(props::JSON ->> 'k', '7')::INTEGER::DOUBLE AS value_score, 1.0::DOUBLE AS key_score, 0.0::DOUBLE AS no_mode FROM events""")
def json_search(spark, d):
    e = table(spark, d, "events").where("props is not null")
    p = F.col("props")
    return e.select("event_id", jx.json_like(p).alias("json_like"), F.get_json_object("props", "$.k").cast("long").alias("k"), jx.search_udf(["7"], "values")(p)["score"].alias("value_score"), jx.search_udf(["K"], "keys")(p)["score"].alias("key_score"), jx.search_udf(["k"], "odd")(p)["score"].alias("no_mode"))


@query("""SELECT event_id, '{"id": ' || event_id || ', "name": "x", "flag": true}' AS cleaned FROM events""")
def json_repair(spark, d):
    broken = F.concat(F.lit("Result: {'id': "), F.col("event_id"), F.lit(", name: 'x', flag: True,"))
    return table(spark, d, "events").select("event_id", jx.clean_json_udf(broken).alias("cleaned"))


@query(f"""WITH {LESSONS} SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview,
  CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 50) || '...' || right(text, 50) END AS safe, string_split(problem, chr(10))[1] AS display, array_to_string(tags, ', ') AS tag_list,
  trim(CASE WHEN trim(problem) = '' THEN '' ELSE trim(problem) || CASE WHEN trim(solution, ' ') = '' THEN '' ELSE chr(10) END END || trim(solution, ' ')) AS embedding_text FROM lessons""")
def previews(spark, d):
    t = F.col("text")
    return lessons(spark, d).select("doc_id", tx.preview(t).alias("preview"), tx.log_safe(t).alias("safe"), tx.first_line(F.col("problem")).alias("display"), F.array_join("tags", ", ").alias("tag_list"), tx.embedding_text(F.col("problem"), F.col("solution")).alias("embedding_text"))


@query("""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]') AS t, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(t)::INTEGER AS n_tokens, CASE WHEN len(w) <= 20 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:10], ' ') || ' ... ' || array_to_string(w[len(w) - 9:], ' ') END AS shortened FROM s""")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_count(F.col("text")).alias("n_tokens"), tx.truncate_tokens(F.col("text"), 20).alias("shortened"))


_SENTENCES = """sent AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '') AS s FROM documents)"""


@query(f"""WITH RECURSIVE {_SENTENCES}, n AS (SELECT doc_id, s, list_transform(s, lambda x: len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\s]'))) AS c FROM sent),
fold AS (SELECT doc_id, s, c, 1 AS i, 0 AS chunk, '' AS open, 0 AS size, '' AS closed, -1 AS closed_at FROM n WHERE len(s) > 0
  UNION ALL SELECT doc_id, s, c, i + 1, CASE WHEN open <> '' AND size + c[i] > 60 THEN chunk + 1 ELSE chunk END,
    CASE WHEN open <> '' AND size + c[i] > 60 THEN s[i] || chr(10) ELSE open || s[i] || chr(10) END,
    CASE WHEN open <> '' AND size + c[i] > 60 THEN c[i] ELSE size + c[i] END,
    CASE WHEN open <> '' AND size + c[i] > 60 THEN open ELSE '' END, CASE WHEN open <> '' AND size + c[i] > 60 THEN chunk ELSE -1 END
  FROM fold WHERE i <= len(s)),
parts AS (SELECT doc_id, closed_at AS ordinal, closed AS chunk FROM fold WHERE closed_at >= 0 UNION ALL SELECT doc_id, chunk, open FROM fold WHERE i = len(s) + 1)
SELECT doc_id, ordinal::INTEGER AS ordinal, md5(chunk) AS chunk_md5, sha256(chunk) AS section_id FROM parts""")
def sentence_packing(spark, d):
    rows = ch.packed(table(spark, d, "documents"), "doc_id", most=60)
    return rows.select("doc_id", "ordinal", F.md5("chunk").alias("chunk_md5"), "section_id")


@query("""WITH n AS (SELECT doc_id, text, len(regexp_extract_all(text, chr(10))) AS lines FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest([{'ordinal': 0, 'number': '1', 'title': 'First', 'content': trim(text, chr(10)), 'start_line': 2, 'path': ['1 First']},
  {'ordinal': 1, 'number': '1.1', 'title': 'Part', 'content': 'x', 'start_line': 4 + lines, 'path': ['1 First', '1.1 Part']}, {'ordinal': 2, 'number': '2', 'title': 'Second', 'content': 'y', 'start_line': 6 + lines, 'path': ['2 Second']}], recursive := true) FROM n)
SELECT doc_id, ordinal::INTEGER AS ordinal, number, title, content, start_line::INTEGER AS start_line, path, list_transform(path, lambda x: sha256(x)) AS hashes FROM s""")
def section_split(spark, d):
    text = F.concat(F.lit("intro\n**1 First**\n"), F.col("text"), F.lit("\n**1.1 Part**\nx\n**2 Second**\n"), F.lit("y"))
    return ch.sections(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id")


@query("""SELECT conv_id, turn, text AS code, CASE WHEN before_role = 'user' THEN before_text ELSE '' END AS description, sha256(text) AS section_id
FROM (SELECT *, lag(role) OVER w AS before_role, lag(text) OVER w AS before_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND trim(text) <> ''""")
def preceding_rows(spark, d):
    return fs.preceding(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", "user", "assistant")


# Tables on pages: lineitem rows of an order as boxes.
_BOX = """box AS (SELECT l_orderkey AS page, l_linenumber AS id, (l_linenumber * 10)::DOUBLE AS x1, l_quantity AS y1, (l_linenumber * 10)::DOUBLE + 15 AS x2, l_quantity + 20 AS y2 FROM lineitem)"""


def _boxes(spark, d):
    x = (F.col("l_linenumber") * 10).cast("double")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), F.struct(x.alias("x1"), F.col("l_quantity").alias("y1"), (x + 15).alias("x2"), (F.col("l_quantity") + 20).alias("y2")).alias("bbox"))


@query(f"""WITH {_BOX}, p AS (SELECT a.page, a.id AS left_id, b.id AS right_id, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i FROM box a JOIN box b ON a.page = b.page AND a.id < b.id)
SELECT page, left_id, right_id, round(i / (600 - i), 6) AS iou FROM p WHERE i / (600 - i) > 0.1""")
def overlapping_boxes(spark, d):
    b = _boxes(spark, d)
    return tb.overlapping(b, b, 0.1).where("left_id < right_id").withColumn("iou", F.round("iou", 6))


@query("""SELECT o_orderkey AS page, min(l_linenumber) AS item_id FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 GROUP BY o_orderkey""")
def nearest_on_page(spark, d):
    items = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"))
    return tb.first_on_page(table(spark, d, "orders").select(F.col("o_orderkey").alias("page")), items)


@query("""WITH q AS (SELECT l_orderkey AS id, avg(CASE WHEN l_returnflag <> 'N' THEN 1.0 ELSE 0.0 END) AS complete, avg(l_quantity * 2) AS acc, avg(l_tax * 100) AS white, avg(1 - l_discount) AS consistent FROM lineitem GROUP BY 1)
SELECT id, round(complete, 6) AS completeness, round(least(greatest((0.4 * least(greatest(acc / 100, 0), 1) + 0.3 * complete + 0.1 * consistent + 0.2 * greatest(0, 1 - white / 100)) * 100, 0), 100), 4) AS confidence FROM q""")
def table_confidence(spark, d):
    li = table(spark, d, "lineitem")
    cells = li.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise(F.lit(" ")).alias("cell"))
    complete = tb.completeness(cells, "id")
    rest = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.avg(F.col("l_quantity") * 2).alias("acc"), F.avg(F.col("l_tax") * 100).alias("white"), F.avg(1 - F.col("l_discount")).alias("consistent"))
    q = complete.join(rest, "id")
    score = tb.confidence(tb.accuracy_part(F.col("acc"), F.lit(False)), F.col("completeness"), F.col("consistent"), tb.whitespace_part(F.col("white")))
    return q.select("id", F.round("completeness", 6).alias("completeness"), F.round(score, 4).alias("confidence"))


@query("""WITH m AS (SELECT l_suppkey AS page, l_shipmode AS params, avg(l_quantity) AS q, min(l_linenumber) AS f FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1, 2)
SELECT page, params, round(q, 6) AS mean_quality FROM m QUALIFY row_number() OVER (PARTITION BY page ORDER BY q DESC, f, params DESC) = 1""")
def best_parameters(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), F.concat("l_returnflag", "l_linestatus").alias("params"), F.col("l_quantity").alias("quality"), F.col("l_linenumber").alias("trial"))
    return tb.best_parameters(r).withColumn("mean_quality", F.round("mean_quality", 6))


@query("""WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS table_id, max(l_quantity)::INTEGER AS rows, l_linenumber AS page, max(l_returnflag) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber),
f AS (SELECT *, coalesce(c = lead(c) OVER w AND (abs(rows - lead(rows) OVER w) / greatest(rows, lead(rows) OVER w)::DOUBLE <= 0.5 OR rows = 1 OR lead(rows) OVER w = 1) AND lead(page) OVER w - page BETWEEN 0 AND 1, false) AS fits,
  row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY table_id)),
h AS (SELECT *, fits AND (n - coalesce(max(CASE WHEN NOT fits THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 1 AS head FROM f),
o AS (SELECT doc_id, table_id, CASE WHEN head THEN [table_id, lead(table_id) OVER w] ELSE [table_id] END AS merged, CASE WHEN head THEN rows + lead(rows) OVER w ELSE rows END AS rows,
  page AS first_page, CASE WHEN head THEN lead(page) OVER w ELSE page END AS last_page, coalesce(lag(head) OVER w, false) AS taken FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n))
SELECT doc_id, table_id, merged, rows, first_page, last_page FROM o WHERE NOT taken""")
def merge_tables(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), "l_linenumber").agg(F.max("l_quantity").cast("int").alias("rows"), F.max("l_returnflag").alias("flag"))
    t = li.select("doc_id", F.col("l_linenumber").cast("long").alias("table_id"), "rows", F.col("l_linenumber").alias("page"), F.array("flag").alias("columns"))
    return tb.merge_adjacent(t)


@query("""SELECT p_partkey, [['a', 'b'], [p_brand, p_type]] AS cells FROM part""")
def markdown_tables(spark, d):
    p = table(spark, d, "part").where("p_brand is not null")
    text = F.concat(F.lit("| a | b |\n|---|:-:|\n| "), "p_brand", F.lit(" | "), "p_type", F.lit(" |\n| only one |"))
    return p.select("p_partkey", mx.table_rows(text).alias("cells"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'git' WHEN n_nationkey % 3 = 1 THEN 'web' ELSE 'local' END AS source_type, lower(n_name) || '_x' AS safe, n_name AS alt, 'http://x/' || n_nationkey || '.png' AS image_url FROM nation""")
def source_types(spark, d):
    n = table(spark, d, "nation")
    where = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("https://github.com/a/"), "n_nationkey")).when(F.col("n_nationkey") % 3 == 1, F.lit("https://x.org/github.com")).otherwise(F.lit("/data/x"))
    image = mx.image(F.concat(F.lit("see ![") , "n_name", F.lit("](http://x/"), "n_nationkey", F.lit(".png) here")))
    return n.select("n_nationkey", urls.source_type(where).alias("source_type"), urls.safe_name(F.concat(F.lower("n_name"), F.lit("_x"))).alias("safe"), image["alt"].alias("alt"), image["url"].alias("image_url"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, o_orderdate AS back FROM orders""")
def iso_times(spark, d):
    iso = times.to_iso(F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", iso.alias("iso"), times.from_iso(iso).alias("back"))


@query("""SELECT sum(octet_length(encode(text)))::BIGINT AS bytes, sum(octet_length(encode(text))) <= 1073741824 AS fits FROM documents""")
def download_size(spark, d):
    return fs.total_size(table(spark, d, "documents").select(F.octet_length("text").cast("long").alias("length")), 2**30)


@query("""SELECT doc_id, 'src3' AS wanted FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id) WHERE source = 'src3'""")
def candidate_semi_join(spark, d):
    docs = table(spark, d, "documents").where("source = 'src3'")
    return st.among(docs, table(spark, d, "labels").where("quality = 1"), "doc_id").select("doc_id", F.lit("src3").alias("wanted"))


@query("""SELECT doc_id, lang, source FROM documents WHERE doc_id = 7""")
def point_lookup(spark, d):
    return st.get(table(spark, d, "documents"), "doc_id", 7).select("doc_id", "lang", "source")


@query("""SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 15""")
def collection_scan(spark, d):
    return st.first_rows(table(spark, d, "documents"), "doc_id", 15).select("doc_id", "lang")


@query("""SELECT doc_id, lang FROM documents WHERE false""")
def truncated(spark, d):
    return st.truncate(table(spark, d, "documents").select("doc_id", "lang"), True)


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS term FROM documents)
SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) >= 5""")
def document_frequencies(spark, d):
    rows = table(spark, d, "documents").select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df")).where("df >= 5")


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS term FROM documents)
SELECT term, count(*) AS df FROM t GROUP BY term""")
def all_document_frequencies(spark, d):
    rows = table(spark, d, "documents").select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"))


@query("""SELECT conv_id, list_sort(list_distinct(list(role))) AS roles, count(*) AS n_turns FROM conversations GROUP BY conv_id""")
def distinct_sets(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(jx.distinct_terms(F.collect_set("role")).alias("roles"), F.count("*").alias("n_turns"))


@query("""SELECT doc_id, md5(text) AS section_id, doc_id AS last FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1""")
def chunk_upsert(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("section_id"), F.col("doc_id").alias("last"))
    return st.upsert(rows.limit(0), rows, "section_id", "last").select("doc_id", "section_id", "last")


@query(f"""WITH {LESSONS}, e AS (SELECT doc_id, trim(CASE WHEN trim(problem) = '' THEN '' ELSE trim(problem) || CASE WHEN trim(solution, ' ') = '' THEN '' ELSE chr(10) END END || trim(solution, ' ')) AS t FROM lessons),
w AS (SELECT doc_id, list_transform(list_filter(string_split_regex(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: ('0x' || substr(md5(x), 1, 7))::INT % 16) AS h FROM e),
c AS (SELECT doc_id, CASE WHEN len(h) > 0 THEN list_transform(range(16), lambda i: len(list_filter(h, lambda x: x = i))::DOUBLE) END AS c FROM w)
SELECT doc_id, list_transform(c, lambda x: round(x / sqrt(list_sum(list_transform(c, lambda y: y * y))), 6)) AS embedding FROM c""")
def embedded_text(spark, d):
    made = se.embed_text(tx.embedding_text(F.col("problem"), F.col("solution")), 16)
    return lessons(spark, d).select("doc_id", F.transform(made, lambda x: F.round(x, 6)).alias("embedding"))


@query("""SELECT page_id, (contains(lower(html), 'react') OR contains(lower(html), 'vue') OR contains(lower(html), 'angular') OR contains(lower(html), 'svelte')
  OR length(html) - CASE WHEN instr(lower(html), '<body') > 0 THEN instr(lower(html), '<body') - 1 ELSE 0 END < 1500) AS browser FROM pages""")
def needs_browser(spark, d):
    return table(spark, d, "pages").select("page_id", urls.needs_browser(F.col("html")).alias("browser"))
