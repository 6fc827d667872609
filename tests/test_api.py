"""The workspace's verbs, robots files, messages and folder extraction."""

import time

import pytest
from pyspark.sql import functions as F

from quillspark.api import EDGE, LESSON, DownloadRequest, Workspace
from quillspark.functions import messages as ms, urls
from quillspark.operators import extract


def lesson(spark, *rows):
    full = [(k, p, s, None, None, t, None, None, None, None, None, v) for k, p, s, t, v in rows]
    return spark.createDataFrame(full, LESSON)


def test_requests():
    assert DownloadRequest("website", "https://e.com/a?b").download_id == "https_e_com_a_b"
    for bad in (("ftp", "x"), ("git", "https://e.com/r.git"), ("website", "e.com")):
        with pytest.raises(ValueError):
            DownloadRequest(*bad)
    with pytest.raises(ValueError):
        DownloadRequest("website", "https://e.com", depth=-1)


def test_download_and_search(spark):
    w = Workspace(spark)
    with pytest.raises(KeyError):
        w.search_pages("none", ["x"], "p")
    pages = spark.createDataFrame([(1, "https://e.com/1", "<body><p>apple</p></body>")], "page_id long, url string, html string")
    w.download(DownloadRequest("website", "https://e.com", "job"), pages)
    assert w.status("job").first()["status"] == "completed" and w.index("job").first()["fetch_status"] == "success"
    assert w.search_pages("job", ["apple"], "p").first()["content_preview"] == "apple"
    w._set("job", "running")
    with pytest.raises(RuntimeError):
        w.download(DownloadRequest("website", "https://e.com", "job"), pages)
    assert w.health()["status"] == "ok"


def test_times_and_keys_stay(spark):
    w = Workspace(spark)
    pages = spark.createDataFrame([(1, "https://e.com/1", "<p>x</p>")], "page_id long, url string, html string")
    w.download(DownloadRequest("website", "https://e.com", "job"), pages)
    w.add_lesson(lesson(spark, (None, "p", "s", [], None), (None, "p", "s", [], None)))
    first = w.status("job").collect(), sorted(w.lessons.collect())
    time.sleep(1.1)
    assert (w.status("job").collect(), sorted(w.lessons.collect())) == first
    assert first[0][0].start_time <= first[0][0].end_time and len({r["_key"] for r in first[1]}) == 2


def test_a_download_fails(spark):
    w = Workspace(spark)
    broken = spark.range(3).select(F.col("id").alias("page_id"), F.raise_error(F.lit("cut off")).alias("url"), F.lit("").alias("html"))
    with pytest.raises(Exception, match="cut off"):
        w.download(DownloadRequest("website", "https://e.com", "job"), broken)
    state = w.status("job").first()
    assert state.status == "failed" and "cut off" in state.error_details and state.end_time is not None
    with pytest.raises(RuntimeError):
        w.search_pages("job", ["x"], "p")


def test_knowledge_base(spark):
    w = Workspace(spark)
    w.add_lesson(lesson(spark, ("a", "json parse", "use a parser", ["json"], [1.0, 0.0]), ("b", "shell quotes", "quote it", ["shell"], [0.0, 1.0]), ("c", " ", "no problem given", [], None)))
    assert w.lessons.count() == 2 and w.get_lesson("a").first()["timestamp"] is not None
    assert [r["_key"] for r in w.search_bm25("parser").collect()] == ["a"]
    assert [r["_key"] for r in w.search_semantic([1.0, 0.1]).collect()] == ["a"]
    assert w.search_hybrid("shell", [0.0, 1.0]).first()["_key"] == "b"
    assert [r["_key"] for r in w.search_keyword(["quote"]).collect()] == ["b"] and [r["_key"] for r in w.search_tag(["json"]).collect()] == ["a"]
    w.update_lesson(spark.createDataFrame([("a", "high")], "_key string, severity string"))
    assert w.get_lesson("a").first()["severity"] == "high" and w.get_lesson("a").first()["problem"] == "json parse"
    w.add_relationship(spark.createDataFrame([("e1", "a", "b", "RELATED", "both parse", None, {}), ("e2", "b", "a", "", "x", None, {})], EDGE))
    assert [r.vertex for r in w.traverse("a").collect()] == ["b"]
    w.delete_lesson(spark.createDataFrame([("b",), ("zz",)], "_key string"))
    assert w.lessons.count() == 1 and w.edges.count() == 0
    w.delete_relationship(spark.createDataFrame([("e1",)], "_key string"))


def test_robots(spark):
    rows = spark.createDataFrame([("https://e.com/private/x", "User-agent: *\nDisallow: /private"), ("https://e.com/x", "User-agent: *\nDisallow: /private"), ("https://e.com/x", None), ("https://e.com/x", "")], "u string, r string")
    assert [x[0] for x in rows.select(urls.robots_allow(F.col("u"), F.col("r"))).collect()] == [False, True, True, True]
    assert rows.select(urls.origin(F.col("u"))).first()[0] == "https://e.com"


def test_messages(spark):
    items = [("text", " hi ", None), ("text", " ", None), ("image_url", None, "https://x/y.png"), ("image_url", None, "z.png")]
    rows = spark.createDataFrame([(items,), ([("text", "a", None)],), (None,)], f"m {ms.ITEMS}")
    assert [r[0] for r in rows.select(ms.is_multimodal(F.col("m"))).collect()] == [True, False, False]
    kept = rows.select(ms.normalised(F.col("m"), 1).alias("m")).first()["m"]
    assert [(x.type, x.text or x.image_url) for x in kept] == [("text", "hi"), ("image_url", "https://x/y.png")]
    kinds = spark.createDataFrame([("https://x",), ("data:image/png;base64,AA",), ("a.png",), (None,)], "s string")
    assert [r[0] for r in kinds.select(ms.image_kind(F.col("s"))).collect()] == ["url", "base64", "file", None]


def test_extract_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\ntext here\n\n```python\nx = 1\n```\n")
    (tmp_path / "b.html").write_text("<body><pre>code()</pre><p>para</p></body>")
    (tmp_path / "c.txt").write_text("plain text")
    (tmp_path / "d.lock").write_text("no")
    rows, metrics = extract.extract_folder(spark, str(tmp_path))
    got = {(r.relative, r.type) for r in rows.collect()}
    assert got == {("a.md", "text"), ("a.md", "code"), ("b.html", "code"), ("b.html", "text"), ("c.txt", "text")}
    assert metrics.get["files"] == 3
    assert extract.search_blocks(rows, "TEXT").count() == 2
    only, _ = extract.extract_folder(spark, str(tmp_path), first_only=True)
    assert only.count() == 3
