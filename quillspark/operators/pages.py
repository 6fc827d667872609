"""Search in fetched pages: keyword scan, selector extraction, block search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import html as hx, jsontext as jx, markdown as mx, text as tx, urls
from quillspark.functions.arrow import bound_batches
from quillspark.functions.code import valid_language_udf


def scan(pages: DataFrame, keywords, html: str = "html") -> DataFrame:
    """Pages whose text holds all keywords; without a keyword none.

    The raw page is tested first, natively: a plain word of the text stands in the page too,
    unless the page has entities, so pages without any are dropped before they are parsed.
    """
    words = tx.clean_keywords(keywords)
    if not words:
        return pages.limit(0)
    bound_batches(pages.sparkSession)
    plain = [w for w in words if w.isascii() and w.isalnum()]
    rows = pages.where(tx.contains_all(F.col(html), plain) | F.contains(html, F.lit("&"))) if plain else pages
    return rows.withColumn("page_text", hx.page_text_udf(F.col(html))).where(tx.contains_all(F.col("page_text"), words))


def extract(pages: DataFrame, selector: str, html: str = "html", keywords=None) -> DataFrame:
    """Texts of the selected elements as ``snippets``, on request only those with all keywords."""
    bound_batches(pages.sparkSession)
    out = pages.withColumn("snippets", hx.selected_udf(selector)(F.col(html)))
    if tx.clean_keywords(keywords):
        out = out.withColumn("snippets", F.filter("snippets", lambda s: tx.contains_all(s, keywords)))
    return out


def search(pages: DataFrame, scan_keywords, selector: str, extract_keywords=None, limit: int = 10, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One result for each page: the joined snippets' preview, in the order of the index."""
    if not selector or not selector.strip():
        raise ValueError("a selector is needed")
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    found = extract(scan(pages, scan_keywords, html), selector, html).where("size(snippets) > 0")
    rows = found.select(key, F.col(url).alias("original_url"), urls.local_path(F.col(url)).alias("local_path"), F.array_join("snippets", " ... ").alias("content"))
    rows = rows.where(tx.contains_all(F.col("content"), extract_keywords or []))
    return rows.orderBy(key).limit(limit).select(key, "original_url", "local_path", tx.preview(F.col("content")).alias("content_preview"), F.lit(selector).alias("selector_matched"))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): followable links in absolute, canonical form, each once a page."""
    bound_batches(pages.sparkSession)
    raw = pages.select(F.col(url).alias("src"), F.explode(hx.links_udf(F.col(html))).alias("href")).where(urls.followable(F.col("href")))
    absolute = raw.select("src", urls.joined(F.col("src"), F.col("href")).alias("to")).where(F.col("to").rlike("^https?://"))
    return absolute.select("src", urls.canonical(F.col("to")).alias("dst")).distinct()


def same_site(links_: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """Links to the same host that weren't visited."""
    near = links_.where(urls.host_of(F.col("src")) == urls.host_of(F.col("dst")))
    return near.join(visited.select(F.col(url).alias("dst")), "dst", "left_anti")


def blocks(pages: DataFrame, content: str = "html", kind: str = "html") -> DataFrame:
    """Content blocks of HTML or Markdown, one row each, with their ordinal."""
    bound_batches(pages.sparkSession)
    f = hx.html_blocks if kind == "html" else mx.markdown_blocks
    return pages.select("*", F.posexplode(mx.rows_udf(f, mx.BLOCK)(F.col(content))).alias("ordinal", "block")).drop(content).select("*", "block.*").drop("block")


def block_search(blocks_: DataFrame, keywords, key: str, json_mode: str | None = None, limit: int = 10) -> DataFrame:
    """Blocks that match by their kind; code first, then by score.

    JSON: structure search, or any keyword in its raw text.  Code: has to parse and hold all
    keywords, else fenced code counts as text.  Text: all keywords.
    """
    words = tx.clean_keywords(keywords)
    any_raw = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("content"), w)) if words else F.lit(False)
    every = tx.contains_all(F.col("content"), words)
    share = tx.keyword_fraction(F.col("content"), words)
    rows = blocks_.where(every | ((F.col("type") == "json") & (any_raw | F.lit(json_mode is not None))))
    found = jx.search_udf(words, json_mode or "")(F.col("content"))
    rows = rows.withColumn("json_match", F.when(F.col("type") == "json", found)).withColumn("valid", F.when(F.col("type") == "code", valid_language_udf(F.col("content"), F.col("language"))))
    rows = rows.withColumn("any_raw", any_raw).withColumn("every", every).withColumn("share", share)
    context = (
        F.when((F.col("type") == "json") & ((F.col("json_match.score") > 0) | F.col("any_raw")), "json")
        .when((F.col("type") == "code") & F.col("valid").isNotNull() & F.col("every"), "code")
        .when((F.col("type") == "code") & F.col("valid").isNull() & (F.col("block_type") == "fenced") & F.col("every"), "text")
        .when((F.col("type") == "text") & F.col("every"), "text")
    )
    mode = F.when(F.col("json_match.score") > 0, F.lit(json_mode)).when(jx.json_like(F.col("content")), "keyword_in_raw_json").otherwise("invalid_json_raw")
    rows = rows.withColumn("search_context", context).where("search_context is not null")
    rows = rows.withColumn("match_mode", F.when(F.col("type") == "json", mode)).withColumn("score", F.when(F.col("type") == "json", F.coalesce("json_match.score", F.lit(0.0))).otherwise(F.col("share")))
    order = [F.col("search_context") != "code", F.col("score").desc(), F.col(key), F.col("ordinal")]
    picked = rows.orderBy(*order).limit(limit)
    ranked = picked.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.select(key, "ordinal", "type", "search_context", "match_mode", "score", "start_line", "end_line", tx.preview(F.col("content"), 100).alias("content_preview"), "rank")
