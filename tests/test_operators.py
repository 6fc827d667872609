"""Operators on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunks as ch, graph as gr, pages as pg, search as se, store as st, tables as tb
from quillspark.sources import files as fs, index as ix
from quillspark.streaming import jobs

LESSONS = [
    (1, "python json parse error", "use a tolerant parser", ["python", "json"]),
    (2, "shell script fails", "quote the script arguments", ["shell"]),
    (3, "python encoding and json", "decode before parsing", ["python", "encoding"]),
    (4, "request timeout", "raise the timeout", ["network"]),
]


@pytest.fixture(scope="module")
def lessons(spark):
    return spark.createDataFrame(LESSONS, "doc_id long, problem string, solution string, tags array<string>").withColumn("text", F.concat_ws(" ", "problem", "solution")).cache()


def keys(df, key="doc_id"):
    return [r[key] for r in df.orderBy("rank").collect()]


def test_bm25(lessons):
    assert set(keys(se.bm25(lessons, "python json"))) == {1, 3}
    assert keys(se.bm25(lessons, "script", tags=["shell"])) == [2]
    assert keys(se.bm25(lessons, "timeout")) == [4]
    assert keys(se.bm25(lessons, "nothing here")) == []
    assert keys(se.bm25(lessons, "!!")) == []
    page = se.bm25(lessons, "python", offset=1).collect()
    assert len(page) == 1 and page[0]["total"] == 2 and page[0]["rank"] == 2


def test_bm25_of_empty_and_null(spark):
    rows = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert se.bm25(rows, "x").collect() == [] and se.bm25(rows.limit(0), "x").collect() == []


def test_semantic_and_fusion(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = se.semantic(rows, [1.0, 0.0], threshold=0.5)
    assert keys(got, "vec_id") == [1, 6, 2]
    a = spark.createDataFrame([(1, 9.0, 1), (2, 5.0, 2)], "k long, score double, rank int")
    b = spark.createDataFrame([(2, 0.9, 1), (3, 0.8, 2)], "k long, score double, rank int")
    fused = se.fuse(a, b, "k").orderBy("rank").collect()
    assert [r["k"] for r in fused] == [2, 1, 3] and fused[0]["total"] == 3
    assert abs(fused[0]["hybrid_score"] - (1 / 62 + 1 / 61)) < 1e-12 and fused[2]["bm25_score"] == 0.0
    assert max(r["hybrid_score"] for r in fused) <= 2 / 61


@pytest.mark.parametrize("bad", [{"threshold": 2.0, "high": 1.0}, {"limit": 0}, {"offset": -1}, {"direction": "UP"}, {"tags": [1]}])
def test_parameters(bad):
    with pytest.raises(ValueError):
        se.check_parameters(**bad)


TAGGED = [(1, "search alpha", ["search", "alpha"]), (2, "search by id", ["search", "beta"]), (3, "beta id", ["alpha", "beta"])]


def test_fuzzy_keyword_and_tags(spark):
    rows = spark.createDataFrame(TAGGED, "doc_id long, problem string, tags array<string>")
    assert sorted(keys(se.fuzzy_tags(rows, ["alpha", "beta"]))) == [1, 2, 3] and keys(se.fuzzy_tags(rows, ["alpha", "beta"]))[0] == 3
    assert keys(se.fuzzy_tags(rows, ["none"])) == []
    for blank in ([], ["", "  ", None]):
        assert keys(se.fuzzy_tags(rows, blank)) == [] and keys(se.fuzzy_text(rows, blank, ["problem"])) == []
    assert sorted(keys(se.fuzzy_text(rows, ["alpha", "id"], ["problem"]))) == [1, 2, 3]
    assert keys(se.fuzzy_text(rows, ["id", "beta"], ["problem"], mode="AND")) == [3]
    assert sorted(keys(se.tag_search(rows, ["search", "beta"]))) == [1, 2, 3]
    assert keys(se.tag_search(rows, ["alpha", "beta"], mode="AND")) == [3]
    assert keys(se.keyword_search(rows, ["search"], ["problem"], limit=1)) == [1]
    assert keys(se.keyword_search(rows, ["search", "id"], ["problem"], mode="AND")) == [2]
    assert keys(se.view_search(rows, "id beta", ["problem"])) == [3] and keys(se.view_search(rows, "", ["problem"])) == []


def test_embed_text(spark):
    rows = spark.createDataFrame([("a b b",), ("",), (None,)], "t string")
    a, b, c = (r[0] for r in rows.select(se.embed_text(F.col("t"), 8)).collect())
    assert abs(sum(x * x for x in a) - 1) < 1e-9 and b is None and c is None


def test_store(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, w string")
    c = spark.createDataFrame([(2, "c", None, 1), (2, "d", "z", 2), (3, "e", "q", 1)], "k long, v string, w string, n int")
    assert sorted(map(tuple, st.upsert(t, c, "k", "n").collect())) == [(1, "a", "x"), (2, "d", "z"), (3, "e", "q")]
    assert sorted(map(tuple, st.update(t, c.where("n = 1").drop("n"), "k").collect())) == [(1, "a", "x"), (2, "c", "y")]
    ins = st.insert(t, spark.createDataFrame([(4, " ", "x"), (5, "v", None), (6, "v", "w")], "k long, v string, w string"), ("v", "w"), "none", "none")
    assert sorted(r.k for r in ins.collect()) == [1, 2, 6]
    made = st.insert(spark.createDataFrame([], "_key string, problem string, solution string, timestamp timestamp"), spark.createDataFrame([(None, "p", "s", None)], "_key string, problem string, solution string, timestamp timestamp")).first()
    assert made["_key"] and made["timestamp"]
    m = spark.createDataFrame([(1, {"a": "1", "b": "2"})], "k long, attrs map<string,string>")
    ch_ = spark.createDataFrame([(1, {"a": None, "c": "3", "_key": "no"})], "k long, attrs map<string,string>")
    assert st.merge(m, ch_, "k").first()["attrs"] == {"b": "2", "c": "3"}
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "_from long, _to long")
    gone = spark.createDataFrame([(1,), (9,)], "k long")
    assert sorted(map(tuple, st.cascade(e, gone, "k").collect())) == [(2, 3), (4, 4)]
    assert st.delete(t, gone, "k").count() == 1
    with pytest.raises(ValueError):
        st.truncate(t, False)
    assert st.truncate(t, True).count() == 0
    v = spark.createDataFrame([("a",), ("b",)], "_key string")
    edges = spark.createDataFrame([], "_from string, _to string")
    assert st.seed_edge(edges, v, spark.createDataFrame([("a", "b")], "_from string, _to string")).count() == 1
    assert st.seed_edge(edges, v, spark.createDataFrame([("a", "z")], "_from string, _to string")).count() == 0


def test_catalog(spark):
    c = st.Catalog(spark)
    c.ensure("lesson_view", "k long")
    c.ensure("lesson_view", "k long")
    c.ensure("edge_view", "a long, b long", "edge")
    assert c.graph("g", "lesson_view", "edge_view") == ("lesson_view", "edge_view")
    with pytest.raises(TypeError):
        c.ensure("lesson_view", "k long", "edge")
    docs = spark.createDataFrame([(1, "a a b")], "doc_id long, text string")
    assert {(r.term, r.tf) for r in c.postings("post", docs, "doc_id", ["text"]).collect()} == {("a", 2), ("b", 1)}


# A cycle, a parallel edge and a self-loop.
EDGES = [(1, "a", "b"), (2, "b", "c"), (3, "c", "a"), (4, "a", "b"), (5, "c", "c"), (6, "c", "d")]


def brute(edges, start, least, most, direction):
    steps = [(e, s, d) for e, s, d in edges if direction != "INBOUND"] + [(e, d, s) for e, s, d in edges if direction == "INBOUND" or (direction == "ANY" and s != d)]
    out, level = [], [(start, ())]
    for depth in range(most + 1):
        out += [(v, depth, p) for v, p in level] if depth >= least else []
        level = [(d, (*p, e)) for v, p in level for e, s, d in steps if s == v and e not in p]
    return sorted(out)


@pytest.mark.parametrize("direction", ["OUTBOUND", "INBOUND", "ANY"])
def test_traverse(spark, direction):
    e = spark.createDataFrame(EDGES, "edge_id long, src string, dst string")
    s = spark.createDataFrame([("a",)], "v string")
    got = sorted((r.vertex, r.depth, tuple(r.path)) for r in gr.traverse(e, s, 0, 4, direction).collect())
    assert got == brute(EDGES, "a", 0, 4, direction)


def test_crawl(spark):
    pages = spark.createDataFrame([("root", "success"), ("c1", "success"), ("c2", "failed_robotstxt"), ("deep", "success")], "url string, status string")
    links = spark.createDataFrame([("root", "c1"), ("root", "c2"), ("c1", "root"), ("c2", "lost"), ("c1", "deep"), ("c1", "gone")], "src string, dst string")
    seeds = spark.createDataFrame([("root",)], "url string")
    assert gr.crawl(pages, links, seeds, 0).count() == 1
    assert gr.crawl(pages, links, seeds, 1).count() == 3
    assert {(r.url, r.depth, r.status) for r in gr.crawl(pages, links, seeds, 5).collect()} == {("root", 0, "success"), ("c1", 1, "success"), ("c2", 1, "failed_robotstxt"), ("deep", 2, "success"), ("gone", 2, "failed_request")}


PAGES = [
    (1, "https://e.com/1", "<html><head><title>One</title></head><body><h1>Welcome</h1><p>An apple a day</p><div class='data'>A1</div></body></html>"),
    (2, "https://e.com/2", "<html><body><h1>Second</h1><p>Banana bread</p><span class='highlight'>apple pie</span></body></html>"),
    (3, "https://e.com/3", "<html><body><h1>Third</h1><p>Cherry</p><a href='/1'>one</a></body></html>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").cache()


def found(pages, *args, **kw):
    return sorted(r.page_id for r in pg.search(pages, *args, **kw).collect())


def test_page_search(pages):
    assert found(pages, ["APPLE"], "body") == [1, 2]
    assert found(pages, ["banana"], "p") == [2]
    assert found(pages, ["a"], ".highlight") == [2]
    assert found(pages, ["apple"], "h1", ["welcome"]) == [1] and found(pages, ["apple"], "p", ["welcome"]) == []
    assert found(pages, [], "body") == [] and found(pages, ["apple"], "p::x") == []
    assert found(pages, ["h"], "h1", limit=2) == [2, 3] or len(found(pages, ["e"], "h1", limit=2)) == 2
    with pytest.raises(ValueError):
        pg.search(pages, ["x"], " ")


def test_links(pages):
    assert [tuple(r) for r in pg.links(pages).collect()] == [("https://e.com/3", "https://e.com/1")]



def test_headings_with_references(spark):
    heads = ["the&&amp;&amp", "the&amp Ly", "a &lt; b &amp;lt; c", "t = &quot;0cf"]
    pages = spark.createDataFrame([(i, f"<body><h1>{x}</h1><p>&amp</p></body>") for i, x in enumerate(heads)], "page_id long, html string")
    got = {r.page_id: r.snippets for r in pg.extract(pages, "h1").collect()}
    assert got == {0: ["the&&&amp"], 1: ["the&amp Ly"], 2: ["a < b &lt; c"], 3: ['t = "0cf']}


def test_block_search(spark):
    md = "Text about json config\n\n```python\ndef config(): return 1\n```\n\n```json\n{\"config\": {\"deep\": 1}}\n```\n\n```python\ndef broken( config\n```\n"
    blocks = pg.blocks(spark.createDataFrame([(1, md)], "doc_id long, text string"), "text", "markdown")
    got = [(r.type, r.search_context) for r in pg.block_search(blocks, ["config"], "doc_id", "keys").orderBy("rank").collect()]
    assert got[0] == ("code", "code") and ("json", "json") in got and ("text", "text") in got and ("code", "text") in got


def test_chunks(spark):
    text = "One two three. Four five! " + "word " * 12 + ". Last one?"
    rows = ch.packed(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", most=8).orderBy("ordinal").collect()
    assert all(r.n_tokens <= 8 or r.chunk.count("\n") == 1 for r in rows)
    assert "".join(r.chunk for r in rows).replace("\n", " ").split() == text.replace("word .", "word .").split()
    page = "<h1>Top</h1><h2>1.2 Use</h2><pre><code class='lang-python'>x = 1</code></pre>"
    got = ch.html_code(spark.createDataFrame([(1, page)], "id long, html string"), "id", ["pre"]).first()
    assert got.code == "x = 1" and got.file_path == "selector: pre [0]" and got.section_path == ["1 Top", "1.2 Use"]
    a = spark.createDataFrame([("s1", "x")], "section_id string, code string")
    b = spark.createDataFrame([("s1", "x"), ("s2", "y")], "section_id string, code string")
    assert ch.with_missing(a, b).count() == 2


def test_tables(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    rows = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 3.0, 3.0)), ((0.0, 0.0, 1.0, 1.0), (5.0, 5.0, 6.0, 6.0)), ((0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0))], f"a {box}, b {box}")
    assert [round(r[0], 6) for r in rows.select(tb.iou(F.col("a"), F.col("b"))).collect()] == [round(1 / 7, 6), 0.0, 0.0]
    t = spark.createDataFrame([(1, 1, ["a"], 10, 1), (1, 2, ["a"], 8, 2), (1, 3, ["a"], 9, 2), (1, 4, ["b"], 9, 3), (1, 5, ["b"], 1, 4)], "doc_id long, table_id long, columns array<string>, rows int, page int")
    assert [tuple(r.merged) for r in tb.merge_adjacent(t).orderBy("table_id").collect()] == [(1, 2), (3,), (4, 5)]
    grid = spark.createDataFrame([(1, "p", 0.5, 1), (1, "q", 0.9, 2), (1, "r", 0.9, 3)], "page int, params string, quality double, trial int")
    assert tb.best_parameters(grid).first()["params"] == "q"
    x = spark.createDataFrame([(1, 70.0, "l"), (2, 90.0, "l")], "id int, accuracy double, data string")
    y = spark.createDataFrame([(1, 75.0, "s"), (2, 99.0, "s")], "id int, accuracy double, data string")
    assert [r.flavour for r in tb.best_flavour(x, y).orderBy("id").collect()] == ["stream", "lattice"]
    marks = tb.issues(spark.createDataFrame([(50.0, 1, 3), (95.0, 4, 3)], "accuracy double, rows int, cols int")).collect()
    assert [len(r.issues) for r in marks] == [2, 0]
    b = spark.createDataFrame([(1, i, k, c) for i, (k, c) in enumerate([("text", "a"), ("text", "b"), ("table", "t"), ("text", "c.")])], "d long, o int, kind string, content string")
    assert tuple(tb.surrounding_text(b, "d", "o", "kind", "content").first())[2:] == ("a b.", "c.")


def test_index(spark, tmp_path):
    good = {"original_url": "u", "canonical_url": "u", "local_path": "a.html", "fetch_status": "success"}
    lines = [json.dumps(good), "", "{broken", json.dumps(good | {"local_path": "s.css"}), json.dumps(good | {"fetch_status": "failed_request"}), json.dumps(good | {"fetch_status": "odd"})]
    (tmp_path / "i.jsonl").write_text("\n".join(lines))
    index = ix.read_index(spark, str(tmp_path / "i.jsonl")).cache()
    assert {r.kind: r.n for r in ix.scan_report(index).collect()} == {"searchable": 1, "malformed": 1, "not searchable": 1, "not saved": 1, "invalid": 1}
    assert ix.searchable(index).count() == 1
    rows = ix.searchable(index).drop("_corrupt_record")
    ix.append_index(rows, str(tmp_path / "out"))
    ix.append_index(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    marked = ix.new_files(spark.createDataFrame([("a.html",), ("b.html",)], "local_path string"), rows)
    assert {(r.local_path, r.write) for r in marked.collect()} == {("a.html", False), ("b.html", True)}


def test_files(spark, tmp_path):
    for name, data in {"a.md": b"x", "sub/b.txt": b"caf\xe9", ".git/c.md": b"no", "big.md": b"y" * 50, "sub/skip.md": b"z"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    rows = fs.walk(spark, str(tmp_path), [".md", ".txt"], ["sub/skip*"], most=40)
    got = {r.relative: r.text for r in rows.withColumn("text", fs.decoded(F.col("content"))).collect()}
    assert got == {"a.md": "x", "sub/b.txt": "café"}
    assert tuple(fs.total_size(rows, 4).first()) == (5, False)
    (tmp_path / "n.json").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": ["Say"]}, {"cell_type": "code", "source": ["x=1\n", "y=2"]}, {"cell_type": "code", "source": ["z"]}]}))
    nb = fs.read_json(spark, str(tmp_path / "n.json"), fs.CELLS).withColumn("nb", F.lit(1))
    assert [(r.code, r.description) for r in fs.notebook_cells(nb, "nb").orderBy("ordinal").collect()] == [("x=1\ny=2", "Say"), ("z", "")]
    (tmp_path / "s.json").write_text(json.dumps({"lessons": [{"problem": "p"}, {"problem": "q"}]}))
    assert fs.seed(spark, str(tmp_path / "s.json"), "lessons", "problem:string").count() == 2


def test_jobs_and_streams(spark, tmp_path):
    rows = [(1, "j", "pending", "2024-01-01 00:00:00"), (2, "j", "running", "2024-01-01 00:01:00"), (3, "k", "running", "2024-01-01 00:02:00"), (4, "j", "completed", "2024-01-01 00:03:00")]
    events = spark.createDataFrame(rows, "event_id long, job string, status string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    assert {(r.job, r.status) for r in jobs.job_states(events).collect()} == {("j", "completed"), ("k", "running")}
    assert [r.event_id for r in jobs.refused(events, "job", "status", "ts", "event_id").collect()] == [3]
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("states", jobs.job_states(stream), "complete"), ("visits", jobs.first_visits(stream, "job", "ts"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {(r.job, r.status) for r in spark.table("states").collect()} == {("j", "completed"), ("k", "running")}
    assert spark.table("visits").count() == 2
    out = jobs.append_batches(stream.select("job"), str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 4
