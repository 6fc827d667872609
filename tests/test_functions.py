"""Scalar functions: truth tables and properties."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import fuzzy, html as hx, jsontext as jx, markdown as mx, text as tx, urls
from quillspark.functions.code import code_metadata, valid_language
from quillspark.sources.files import glob_pattern


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


CANONICAL = [
    ("HTTP://Example.COM:80/a/b/", "http://example.com/a/b"),
    ("https://example.com:443", "https://example.com/"),
    ("https://example.com:8443/x", "https://example.com:8443/x"),
    ("//cdn.example.com/lib.js", "http://cdn.example.com/lib.js"),
    ("example.com/page?q=1#top", "http://example.com/page"),
    ("https://example.com/a%20b", "https://example.com/a b"),
    ("https://example.com/a+b", "https://example.com/a+b"),
    ("https://example.com/a%zz", "https://example.com/a%zz"),
    ("  https://example.com/x///  ", "https://example.com/x"),
    ("https://example.com/p;v=1", "https://example.com/p"),
    ("https://example.com/a/../b", "https://example.com/a/../b"),
]


def test_canonical(spark):
    assert column(spark, [a for a, _ in CANONICAL], urls.canonical) == [b for _, b in CANONICAL]


def test_canonical_is_idempotent(spark):
    once = column(spark, [b for _, b in CANONICAL], urls.canonical)
    assert once == [b for _, b in CANONICAL]


def test_local_path(spark):
    (a, b) = column(spark, ["https://example.com/docs/page.html", "https://example.com/docs/image.png?x=1"], urls.local_path)
    assert a.startswith("example.com/example_com_docs_page_html-") and a.endswith(".html")
    assert b.endswith(".png") and len(b) < 400
    kept = column(spark, ["http://e.com/a.PDF", "http://e.com/a.exe", "http://e.com/.png", "http://e.com/a.b/c", "e.com/x.yaml;v=1"], urls.local_path)
    assert [p.rpartition(".")[2] for p in kept] == ["pdf", "html", "html", "html", "yaml"]


def test_local_path_too_long(spark):
    host = "h" * 200 + ".com"
    (a,) = column(spark, [f"http://{host}/{'x' * 300}.md"], lambda u: urls.local_path(u, "/data/" + "b" * 90))
    (b,) = column(spark, [f"http://{host}/x.md"], lambda u: urls.local_path(u, "/data/" + "b" * 250))
    assert a.startswith(f"{host}/url-") and a.endswith(".md") and b is None


LOCAL = ["http://x@127.0.0.1/", "http://user:p@localhost/", "http://localhost./", "http://2130706433/", "http://0x7f000001/", "http://0177.0.0.1/", "http://127.1/", "http://a.test/", "http://b.example", "http://c.invalid/", "http://[::ffff:127.0.0.1]/", "http://a\\@10.0.0.1/", "http://１２７.0.0.1/", "http://loc%61lhost/", "http://8.8.8.8:80:90/", "http://999.1.1.1/"]


@pytest.mark.parametrize("url", LOCAL)
def test_local_targets_in_other_forms(spark, url):
    assert column(spark, [url], urls.unsafe) == [True]


def test_hosts(spark):
    urls_ = ["http://u:p@E.com:81/x@y", "https://e.com./", "http://e.com:/", "mailto:x@e.com", "http://me@8.8.8.8/"]
    assert column(spark, urls_, urls.host_of) == ["e.com", "e.com", "e.com", "", "8.8.8.8"] and column(spark, urls_[-1:], urls.unsafe) == [False]


@pytest.mark.parametrize(
    ("text", "keywords", "expected"),
    [
        ("The quick brown fox", ["quick", "FOX"], True),
        ("The quick brown fox", ["quick", "cat"], False),
        ("The quick brown fox", [], True),
        ("The quick brown fox", ["", None, "  "], True),
        ("The quick brown fox", [" quick "], True),
        (None, ["x"], False),
        (None, [], False),
        ("", ["x"], False),
        ("abc", ["b"], True),
    ],
)
def test_contains_all(spark, text, keywords, expected):
    assert column(spark, [text], lambda v: tx.contains_all(v, keywords)) == [expected]


def test_unsafe(spark):
    bad = ["http://localhost/", "http://127.0.0.1/x", "http://10.1.2.3", "http://[::1]/", "http://169.254.1.1/", "http://printer.local/", "not a url at all:", "http://0.0.0.0/"]
    good = ["https://example.com/", "http://8.8.8.8/"]
    assert column(spark, bad, urls.unsafe) == [True] * len(bad)
    assert column(spark, good, urls.unsafe) == [False] * len(good)
    assert column(spark, ["http://localhost/"], lambda v: urls.unsafe(v, ["localhost"])) == [False]


JSON_LIKE = [('{"a": 1}', True), ("[1, 2]", True), (" {} ", True), ("[]", True), ("1", False), ('"x"', False), ("{a: 1}", False), ("{", False), ("", False), ("true", False), ("[1, 2", False), ('{"a": [1, {"b": null}]}', True)]


def test_json_like(spark):
    assert [jx.is_json_like(t) for t, _ in JSON_LIKE] == [e for _, e in JSON_LIKE]
    assert column(spark, [t for t, _ in JSON_LIKE], jx.json_like) == [e for _, e in JSON_LIKE]
    assert column(spark, [None], jx.json_like) == [False]


def test_json_search():
    value = {"User": {"name": "Ann", "tags": ["x", "Yy"], "active": True}, "n": 12}
    assert jx.search(value, ["user", "n"], "keys")[0] == 1.0
    assert jx.search(value, ["ann", "true", "12", "zz"], "values")[0] == 0.75
    assert jx.search(value, ["user", "tags", "[1]"], "structure") == (1.0, ["[1]", "tags", "user"], ["User.tags[1]"])
    assert jx.search(value, ["tags", "user"], "structure")[0] == 0.0
    assert jx.search(value, ["x"], "other") == (0.0, [], [])


@pytest.mark.parametrize(
    ("text", "expected"),
    [('{"a": 1}', {"a": 1}), ('Here: {"a": 1} ok', {"a": 1}), ("{'a': 'b', c: True,}", {"a": "b", "c": True}), ('[1, 2, {"a": 3', [1, 2, {"a": 3}]), ("plain", "plain"), (None, None)],
)
def test_clean_json(text, expected):
    assert jx.clean_json(text) == expected


@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9))
@settings(max_examples=200, deadline=None)
def test_lcs_equals_brute_force(a, b):
    best = max(len(s) for n in range(len(a) + 1) for s in itertools.combinations(a, n) if _is_subsequence(s, b))
    assert fuzzy.lcs(a, b) == best
    assert 0 <= fuzzy.ratio(a, b) <= 100
    assert fuzzy.partial_ratio(a, b) >= fuzzy.ratio(a, b) - 1e-9 or len(a) != len(b)


def _is_subsequence(s, b):
    it = iter(b)
    return all(c in it for c in s)


def test_a_page_s_tree_goes_with_its_text():
    import gc

    page = "<body><article><h1>a</h1><ul><li><a href='x'>b</a><p>c</ul></article></body>"
    gc.collect()
    gc.disable()
    try:
        for f in (hx.page_text, hx.links, lambda h: hx.selected_texts(h, "h1")):
            assert f(page)
        assert not [x for x in gc.get_objects() if isinstance(x, hx.Node)]
    finally:
        gc.enable()


def test_partial_ratios_align_only_what_can_reach_the_least(spark, monkeypatch):
    words, texts = ["licensed", "that", "it was agreed upon by all"], [None, "", "licens", "licensed under", "tha", "at that", "it was agreed upon by al", "he said it was agreed upon by all of us", "it was agred upon by all of them"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    for w in words:
        for least in (97.0, 60.0):
            want = [0.0 if t is None else (s if (s := fuzzy.partial_ratio(w, t)) >= least else 0.0) for t in texts]
            assert [r[0] for r in rows.select("t", fuzzy.partial_udf(w, least)(F.col("t")).alias("s")).select("s").collect()] == want
    seen = rows.select(fuzzy.partial_udf("that", 97.0)(F.concat(F.col("t"), F.repeat(F.lit("x"), 5000))).alias("s"))
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (NOT Contains" in plan.split("ArrowEvalPython", 1)[1]  # long texts stay outside the workers


def test_partial_ratio():
    assert fuzzy.partial_ratio("cat", "the cat sat") == 100
    assert fuzzy.partial_ratio("", "") == 100 and fuzzy.partial_ratio("", "x") == 0
    assert 60 < fuzzy.partial_ratio("cart", "the cat sat") < 100


PAGE = """<html><head><title>T &amp; U</title><style>p{}</style></head><body>
<nav><a href="/x">X</a> <a href="#top">top</a> <a href="mailto:a@b.c">m</a></nav>
<main><h1>Head</h1><div class="data big" id="d1"><p>One<p>Two <b>bold</b></div>
<script>var hidden = 1;</script>
<ul><li>a<li>b</ul>
<pre><code class="language-python">def f(x):
    return x
</code></pre>
<pre>{"k": [1, 2]}</pre>
<p>Uses <code>inline()</code> here</p></main></body></html>"""


def test_page_text():
    text = hx.page_text(PAGE)
    assert text.startswith("T & U Head") and "hidden" not in text and "X" not in text
    assert hx.page_text("") is None and hx.page_text("<script>x</script>") is None


def test_names_without_a_semicolon_stand_for_no_character():
    page = '<title>a&amp b</title><body><h1>und&&amp;&amp</h1><p class="x&amp y" title="&lt">&lt &copy; &copy2 &notit; &quot;&#38 &#x26; &ampamp; R&D & é&eacute;\ufdd0&\ufdd0</p><a href="?a=1&amp;b=2&copy;&amp">&gt</a></body>'
    assert hx.page_text(page) == 'a&amp b und&&&amp &lt © &copy2 &notit; "& & &ampamp; R&D & éé\ufdd0&\ufdd0 &gt'
    assert hx.selected_texts(page, "h1") == ["und&&&amp"] and hx.selected_texts("<script>if (a&lt) b&&c;</script>", "script") == ["if (a&lt) b&&c;"]
    assert hx.links(page) == ["?a=1&b=2©&"] and hx.selected_texts(page, "p[title='<']") == hx.selected_texts(page, "p")


@pytest.mark.parametrize(
    ("selector", "expected"),
    [
        ("h1", ["Head"]),
        (".data p", ["One", "Two bold"]),
        ("#d1 > p > b", ["bold"]),
        ("li", ["a", "b"]),
        ("h1, b", ["Head", "bold"]),
        ("a[href^='/']", ["X"]),
        ("a[href*=@]", ["m"]),
        ("div.big.data b", ["bold"]),
        ("main > b", []),
        ("", []),
        ("p::first", []),
        ("[[", []),
    ],
)
def test_select(selector, expected):
    assert hx.selected_texts(PAGE, selector) == expected


def test_links_and_blocks(spark):
    assert hx.links(PAGE) == ["/x", "#top", "mailto:a@b.c"]
    assert column(spark, hx.links(PAGE), urls.followable) == [True, False, False]
    blocks = hx.html_blocks(PAGE)
    kinds = {b["content"]: (b["type"], b["language"]) for b in blocks}
    assert kinds["def f(x):\n    return x"] == ("code", "python")
    assert kinds['{"k": [1, 2]}'] == ("json", "json")
    assert kinds["inline()"] == ("code", None)
    assert any(b["type"] == "text" and b["content"] == "One" for b in blocks)


def test_line_spans_do_not_overlap():
    lines = ["a", "b", "a", "b"]
    taken = []
    assert hx.line_span(lines, "a\nb", taken) == (1, 2)
    assert hx.line_span(lines, "a\nb", taken) == (3, 4)
    assert hx.line_span(lines, "a\nb", taken) == (None, None)


MARKDOWN = """# Guide

Some *text* with [a link](http://x).
More text.

## 2.1 Install

Run this:

```python
def go(a, b):
    return a + b
```

```json
{"ok": true}
```

```
```
Last words
"""


def test_markdown_blocks():
    blocks = mx.markdown_blocks(MARKDOWN)
    assert [(b["type"], b["language"]) for b in blocks if b["block_type"] == "fenced"] == [("code", "python"), ("json", "json")]
    assert blocks[1]["content"] == "Some text with a link. More text."
    code = next(b for b in blocks if b["language"] == "python")
    assert (code["start_line"], code["end_line"]) == (10, 13)


def test_markdown_chunks():
    first, second = mx.markdown_chunks(MARKDOWN, "g.md")
    assert first["description"] == "Run this:" and first["functions"] == ["go"]
    assert first["section_path"] == ["2.1 Install"] and second["section_path"] == ["2.1 Install"]
    assert first["section_id"] == mx.sha(first["code"])


def test_hierarchy_closes_sections_that_are_no_prefix():
    tree = mx.Hierarchy()
    seen = []
    for number in ((1,), (1, 1), (1, 1, 2), (1, 2), (2,), (3, 1)):
        tree.enter(number, "t")
        seen.append([x[0] for x in tree.stack])
    assert seen == [[(1,)], [(1,), (1, 1)], [(1,), (1, 1), (1, 1, 2)], [(1,), (1, 2)], [(2,)], [(3, 1)]]


def test_sections_and_rst():
    parts = mx.sections("intro\n**4.1 One**\ntext\n**4.1.2 Two**\nmore")
    assert [(p["number"], p["content"], p["start_line"]) for p in parts] == [("4.1", "text", 2), ("4.1.2", "more", 4)]
    assert parts[1]["path"] == ["4.1 One", "4.1.2 Two"]
    assert mx.sections("no marks")[0]["content"] == "no marks" and mx.sections("") == []
    rst = "Title\n=====\n\nCall it::\n\n    go()\n\n.. code-block:: python\n\n    x = 1\n    y = 2\n\nEnd"
    assert [(b["code"], b["language"]) for b in mx.rst_blocks(rst)] == [("go()", "text"), ("x = 1\ny = 2", "python")]
    assert mx.rst_blocks("x" * 60_000) == []


def test_elements():
    out = mx.elements("# A\n<!-- page: 2 -->\ntext\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n![pic](http://p)\n```py\nx\n```")
    assert [(e["type"], e["page"]) for e in out] == [("text", 2), ("table", 2), ("image", 2), ("code", 2)]


def test_clean_title():
    assert mx.clean_title(" a\u0007b ") == "ab" and mx.clean_title("\u200b") == "Unnamed Section"
    assert mx.clean_title("Ã©tÃ©") == "été" and mx.clean_title("été", True) == "ete"


def test_code():
    assert valid_language("def f(:", "python") != "python"
    assert valid_language("x = 1") == "python" and valid_language("function f() { return 1; }", "js") == "javascript"
    assert valid_language("") is None and valid_language("{ ( }") is None
    meta = code_metadata("class A:\n    pass\ndef f(a, *, b):\n    '''doc'''\n    x = [i for i in a]\n    try:\n        pass\n    except E:\n        pass")
    assert meta["functions"] == ["f"] and meta["parameters"] == ["a, b"] and meta["classes"] == ["A"] and meta["assigned"] == ["x"]
    assert (meta["tries"], meta["comprehensions"], meta["success"]) == (1, 1, True)
    assert not code_metadata("def f(")["success"]


def test_shaping(spark):
    assert column(spark, ["x" * 501, "short"], tx.preview) == ["x" * 500 + "...", "short"]
    long = "a" * 60 + "b" * 60
    assert column(spark, [long, "ok"], tx.log_safe) == ["a" * 50 + "..." + "b" * 50, "ok"]
    assert column(spark, ["data:image/png;base64," + "A" * 200], tx.log_safe)[0].startswith("data:image/png;base64,AAA")
    assert column(spark, ["a b c d e f"], lambda v: tx.truncate_tokens(v, 4)) == ["a b ... e f"]
    assert column(spark, ["1,234.5", "x"], tx.cell_number) == [1234.5, None]
    assert column(spark, ["a\n b"], tx.cell_text) == ["a b"]
    assert column(spark, ["Crème Brûlée!"], lambda v: tx.tokens(v, fold=True)) == [["creme", "brulee"]]


def test_table_and_image(spark):
    table = "| a | b |\n|---|:-:|\n| 1 | 2 |\n| odd |"
    assert column(spark, [table, "no table", "a\nb"], mx.table_rows) == [[["a", "b"], ["1", "2"]], None, None]
    assert column(spark, ["see ![x](http://y/z.png)", "none"], mx.image) == [("x", "http://y/z.png"), None]


def test_glob_pattern():
    import re

    assert re.match(glob_pattern("docs/*.md"), "docs/a.md") and not re.match(glob_pattern("docs/*.md"), "src/a.md")
