"""Converted documents, token counts, fetching and incremental extraction."""

import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from quillspark.functions import bpe, fuzzy, times, urls
from quillspark.operators import chunks as ch, extract, incremental, search as se, store as st, stored, tables as tb
from quillspark.sources import fetch, index as ix

# Vocabulary


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return bpe.Vocabulary()


TEXTS = ["", "Hello world, it's 2024!", "  two  blanks\n\n\ttabs ", "naïve café 日本語 🐈", "a" * 300, "abcabcabc " * 30, "x1y22z333 -- ... ''s", "\x00\x7f ÿ"]


def plainly(v, word):
    parts = [word[i : i + 1] for i in range(len(word))]
    while word not in v.ranks:
        found = [(v.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in v.ranks]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    else:
        parts = [word] if word else []
    return [v.ranks[p] for p in parts]


@given(st_.lists(st_.sampled_from([b"a", b"e", b" t", b"h", b"in", b"g", b"\xc3", b"\xa9", b"er", b"1"]), min_size=1, max_size=30).map(b"".join))
@settings(max_examples=150, deadline=None)
def test_merges_equal_brute_force(vocabulary, word):
    assert vocabulary.ids(word) == plainly(vocabulary, word)


def test_ids_are_those_of_the_library(spark, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as public

    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rows = [(i, t) for i, t in enumerate([*TEXTS, None])]
    got = spark.createDataFrame(rows, "i long, t string").select("i", "t", bpe.ids(F.col("t"), vocabulary).alias("ids"), bpe.count(F.col("t"), vocabulary).alias("n")).collect()
    assert all(r.n == (None if r.t is None else len(r.ids)) for r in got)
    assert all(r.ids == (None if r.t is None else own.encode_ordinary(r.t)) for r in got)


def test_packing_by_a_vocabulary(spark, vocabulary):
    text = " ".join(f"Sentence number {i} has some words, {'more ' * (i % 7)}here." for i in range(40)) + " " + "long " * 80 + "."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "One. One. One.")], "doc_id long, text string")
    out = sorted(ch.packed(docs, "doc_id", most=50, vocabulary=vocabulary).collect(), key=lambda r: (r.doc_id, r.ordinal))
    count = lambda s: sum(len(vocabulary.ids(w.encode())) for w in bpe.regex.findall(vocabulary.pattern, s))
    for r in out:
        lines = [s for s in r.chunk.split("\n") if s]
        assert r.n_tokens == sum(map(count, lines)) and (r.n_tokens <= 50 or len(lines) == 1)
    first = [r for r in out if r.doc_id == 1]
    for a, b in zip(first, first[1:], strict=False):
        assert a.n_tokens + count(b.chunk.split("\n")[0]) > 50, "a chunk ends only when the next sentence doesn't fit"
    assert {r.doc_id for r in out} == {1, 4}


# Boxes


def brute(boxes, others, t):
    out = set()
    for p, i, a in boxes:
        for q, j, b in others:
            if p == q:
                w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                inter = max(w, 0) * max(h, 0)
                union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
                if union > 0 and inter / union > t:
                    out.add((p, i, j, round(inter / union, 9)))
    return out


BOX = "page long, id long, bbox struct<x1:double,y1:double,x2:double,y2:double>"


@pytest.mark.parametrize("threshold", [0.0, 0.01, 0.3, 0.5, 0.95])
def test_grids_find_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))

    def box():
        scale = rng.choice([0.01, 1, 4, 64, 1000])
        x, y = rng.choice([-3, 0, 0.5, 8, 500]) + rng.random() * scale, rng.choice([-100, 0, 16]) + rng.random() * scale
        return (x, y, x + scale * rng.choice([0.001, 0.3, 1, 1]), y + scale * rng.choice([0.001, 0.5, 1, 1]))

    a = [(rng.randrange(3), i, box()) for i in range(150)]
    b = [(rng.randrange(3), i, box()) for i in range(100)] + [(p, 200 + i, x) for p, i, x in a[:50]]
    nan = float("nan")
    odd = [(0, 900, (0.0, 0.0, 0.0, 0.0)), (0, 901, (nan, 0.0, 1.0, 1.0)), (0, 902, (1.0, 1.0, 0.0, 0.0)), (None, 903, (0.0, 0.0, 1.0, 1.0))]
    frame = lambda rows: spark.createDataFrame(rows, BOX)
    got = tb.overlapping(frame(a + odd), frame(b + odd), threshold).collect()
    assert len(got) == len({(r.page, r.left_id, r.right_id) for r in got})
    assert {(r.page, r.left_id, r.right_id, round(r.iou, 9)) for r in got} == brute(a, b, threshold)


def test_a_full_page_does_not_list_all_pairs(spark):
    n = 20_000
    boxes = spark.range(n).selectExpr("0L as page", "id", "named_struct('x1', double(id % 200) * 3, 'y1', double(id div 200) * 3, 'x2', double(id % 200) * 3 + 4, 'y2', double(id div 200) * 3 + 4) as bbox")
    home = tb._cells(boxes.selectExpr("page as p", "id", "bbox as b"), "b", 0, 0).groupBy("p", "grid", "cx", "cy").count()
    away = tb._cells(boxes.selectExpr("page as p", "id", "bbox as b"), "b", 1, 1).groupBy("p", "grid", "cx", "cy").count().withColumnRenamed("count", "m")
    met = home.agg(F.sum(F.col("count") * F.col("count"))).first()[0] + 2 * (home.join(away, ["p", "grid", "cx", "cy"]).agg(F.sum(F.col("count") * F.col("m"))).first()[0] or 0)
    assert met < 60 * n
    assert tb.overlapping(boxes, boxes, 0.5).count() == n


def test_packing_doesn_t_look_sentences_up_again(spark):
    vocabulary = bpe.Vocabulary()
    docs = spark.range(2).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 3000), i -> concat('Word ', i % 1000, '.'))) text")
    out = ch.packed(docs, "doc_id", most=50, vocabulary=vocabulary)
    assert "map_from_entries" not in out._jdf.queryExecution().optimizedPlan().toString()  # a map's keys are searched one by one
    got = out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("most")).collect()
    want = sum(len(vocabulary.ids(b"Word")) + len(vocabulary.ids(f" {i % 1000}".encode())) + len(vocabulary.ids(b".")) for i in range(1, 3001))
    assert [r.most <= 50 for r in got] == [True, True] and len({r.n for r in got}) == 1 and abs(got[0].n - want) <= 3000


def test_boxes_of_one_size_stay_in_their_own_grid(spark):
    boxes = spark.range(60).selectExpr("id % 3 page", "id", "named_struct('x1', id * 2.0D, 'y1', 1.0D, 'x2', id * 2.0D + 15, 'y2', 21.0D) bbox")
    found = tb.overlapping(boxes, boxes, 0.1)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # no second one for boxes of other grids
    assert found.count() == sum(a % 3 == b % 3 and (i := max(0, 15 - 2 * abs(a - b)) * 20) / (600 - i) > 0.1 for a in range(60) for b in range(60))


def test_readings_confirm_each_other(spark):
    a = spark.createDataFrame([(1, 1, (0.0, 0.0, 10.0, 10.0)), (1, 2, (50.0, 0.0, 60.0, 10.0)), (2, 3, (0.0, 0.0, 10.0, 10.0))], BOX)
    b = spark.createDataFrame([(1, 7, (0.0, 0.0, 10.0, 9.0)), (1, 8, (0.0, 0.0, 10.0, 9.0)), (2, 9, (5.0, 5.0, 30.0, 30.0))], BOX)
    assert {(r.page, r.id): (r.confirmed, r.match_id) for r in tb.cross_validated(a, b).collect()} == {(1, 1): (True, 7), (1, 2): (False, None), (2, 3): (False, None)}


# Tables


def test_kinds_of_columns(spark):
    cells = [["1", "2", "", "yes", "1", "x"], ["1,000", "2.5", " ", "TRUE", "no", "1"], ["-3", "1e5", None, "false", "", "2"]]
    row = spark.createDataFrame([(cells, ["h"] * 6)], "rows array<array<string>>, header array<string>")
    assert row.select(tb.column_kinds(F.col("rows"), F.size("header"))).first()[0] == ["whole", "number", "empty", "truth", "text", "text"]
    short = spark.createDataFrame([([["1"], ["2", "x"]], ["a", "b"]), ([], []), ([], ["a"])], "rows array<array<string>>, header array<string>")
    assert [r[0] for r in short.select(tb.column_kinds(F.col("rows"), F.size("header"))).collect()] == [["whole", "text"], [], ["empty"]]
    parts = short.select(tb.consistency(F.col("header"), F.col("rows"))).collect()
    assert [r[0] for r in parts] == [0.0, 0.0, 0.0]


def test_text_that_repeats_a_table_goes(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    tables = [(d, p, " ".join(word() for _ in range(rng.randint(1, 12)))) for d in (1, 2) for p in (1, 2) for _ in range(3)]

    def near(t):
        t = list(t)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("abcde XY\n")
        return "".join(t)

    texts = [(*tables[i % len(tables)][:2], i, near(tables[i % len(tables)][2]) if i % 3 else word()) for i in range(120)] + [(1, 1, 500, None), (1, 1, 501, ""), (None, 1, 502, "x")]
    norm = lambda t: " ".join((t or "").lower().split())
    for least in (60.0, 90.0, 100.0):
        gone = {k for d, p, k, t in texts if norm(t) and any((d, p) == (e, q) and fuzzy.ratio(norm(t), norm(u)) >= least for e, q, u in tables)}
        a, b = spark.createDataFrame(texts, "doc_id long, page long, block_id long, content string"), spark.createDataFrame(tables, "doc_id long, page long, table_text string")
        assert {r.block_id for r in tb.without_similar_text(a, b, least).collect()} == {t[2] for t in texts} - gone
        marked = tb.validated(a.withColumn("type", F.when(F.col("block_id") % 2 == 0, "table").otherwise("text")), b, least).collect()
        assert {r.block_id: r.validated for r in marked} == {t[2]: (t[2] in gone) if t[2] % 2 == 0 else None for t in texts}
    with pytest.raises(ValueError):
        tb.without_similar_text(a, b, 0.0)


@given(st_.lists(st_.tuples(st_.text("abé\n", max_size=12), st_.text("abé\n", max_size=12)), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_shared_characters_bound_the_subsequence(pairs):
    bound = fuzzy.common_characters([a for a, _ in pairs], [b for _, b in pairs])
    assert all(fuzzy.lcs(a, b) <= n for (a, b), n in zip(pairs, bound, strict=True))


def test_nested_blocks_to_any_depth(spark):
    def tree(depth, width):
        return {"type": f"t{depth}", "text": "x" * depth, "children": [tree(depth - 1, width) for _ in range(width)] if depth else []}

    deep = {"type": "leaf", "children": []}
    for i in range(40):
        deep = {"type": f"d{i}", "text": str(i), "children": [{"type": "side"}, deep]}

    def walk(node, path=()):
        yield (list(path), list(path[:-1]) if path else None, len(path), node.get("type"), node.get("text"))
        for i, c in enumerate(node.get("children") or []):
            yield from walk(c, (*path, i))

    docs = {1: tree(4, 3), 2: deep, 3: {"type": "alone", "children": "no list"}, 4: {"type": "x", "children": None}}
    rows = [(i, json.dumps(d)) for i, d in docs.items()] + [(5, "{broken"), (6, None)]
    got = tb.nodes(spark.createDataFrame(rows, "doc_id long, json string"), "doc_id").collect()
    want = [(i, *n) for i, d in docs.items() for n in (walk(d) if i < 3 else [([], None, 0, d["type"], None)])]
    assert sorted((r.doc_id, r.path, r.parent, r.depth, r.type, r.text) for r in got if r.depth) == sorted(w for w in want if w[3])
    assert sorted((r.doc_id, r.type) for r in got if not r.depth) == sorted((w[0], w[4]) for w in want if not w[3])


def test_nested_blocks_read_their_documents_twice_at_most(spark):
    """Once for the number of levels, once for the nodes; each level used to read and parse them again."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = [(i, json.dumps({"type": "d", "text": "[a]]", "children": [{"text": "b", "children": [{"text": None}, None]}, None]})) for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, json string").mapInArrow(counted, "doc_id long, json string")
    got = tb.nodes(df, "doc_id").collect()
    assert read.value <= 2 * len(docs)
    want = [([], None, "d", "[a]]"), ([0], [], None, "b"), ([0, 0], [0], None, None), ([0, 1], [0], None, None), ([1], [], None, None)]
    assert sorted((r.doc_id, r.path, r.parent, r.type, r.text) for r in got) == [(i, *w) for i in range(10) for w in want]


def test_nested_blocks_of_different_kinds_and_too_deep(spark):
    def chain(n):
        return {"text": "0"} if n == 0 else {"text": str(n), "children": [chain(n - 1)]}

    docs = {1: chain(8), 2: chain(9), 3: chain(17), 4: {"children": [{"children": "none"}, {"children": [1]}, [2, [3]]]}, 5: [], 6: None, 7: chain(2)}
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs.items()] + [(8, "[")], "doc_id long, json string")
    got = {}
    for r in tb.nodes(df, "doc_id").collect():
        got.setdefault(r.doc_id, []).append(tuple(r.path))
    assert {i: sorted(p) for i, p in got.items()} == {
        **{i: [(0,) * j for j in range(n + 1)] for i, n in ((1, 8), (2, 9), (3, 17), (7, 2))},
        4: [(), (0,), (1,), (1, 0), (2,)], 5: [()], 6: [()],
    }
    assert tb.nodes(df, "doc_id", most_depth=17).count() == sum(map(len, got.values()))
    for depth in (16, 8, 3):
        with pytest.raises(ValueError):
            tb.nodes(df, "doc_id", most_depth=depth)


# Fetching


def test_a_fetcher_is_read_no_further_than_the_limit(spark):
    def fetcher(url):
        if url == "down":
            raise TimeoutError("slow")
        if url == "gone":
            return 404, {}, iter([b"never read"])
        if url == "announced":
            return 200, {"Content-Length": "99999"}, iter([b"never read"])
        if url == "endless":
            return 200, {"content-length": "odd"}, iter(lambda: b"x" * 60, b"")
        return 200, {}, iter([b"he", b"llo"])

    urls_ = ["down", "gone", "announced", "endless", "fine", "there", None]
    got = fetch.responses(spark.createDataFrame([(u,) for u in urls_], "url string").repartition(3), fetcher, most=100)
    out = {r.url: r for r in fetch.outcome(got, 100, F.col("url") == "there").collect()}
    assert set(out) == set(urls_) - {None}
    assert {u: r.fetch_status for u, r in out.items()} == {"down": "failed_request", "gone": "failed_request", "announced": "failed_request", "endless": "failed_request", "fine": "success", "there": "skipped"}
    assert out["fine"].content_md5 == hashlib.md5(b"hello").hexdigest() and out["fine"].size == 5
    assert out["endless"].error_message == "Downloaded content size 120 exceeds max_size 100" and "TimeoutError" in out["down"].error_message
    assert all(r.fetch_status in ix.STATUSES for r in out.values())
    forced = fetch.outcome(got, None, F.col("url") == "there", force=True).where("url in ('there', 'endless')").collect()
    assert {r.fetch_status for r in forced} == {"success"}


# Incremental extraction


def test_a_second_run_takes_only_what_changed(spark, tmp_path):
    make = lambda name, schema, key: stored.StoredTable.create(spark, f"file://{tmp_path}/{name}", schema, key, 4)
    manifest = make("m", incremental.MANIFEST, "relative")
    blocks = make("b", "block_id string, relative string, ordinal int, content string, section_id string, embedding array<double>", "block_id")
    seen, vectors = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def lines(files):
        def count(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        return files.mapInPandas(count, files.schema).select("relative", F.posexplode(F.split("text", "\n")).alias("ordinal", "content"))

    @F.pandas_udf("array<double>")
    def embedder(texts):
        vectors.add(len(texts))
        return texts.map(lambda t: [float(len(t))])

    def run(**files):
        return incremental.refresh(spark.createDataFrame(list(files.items()), "relative string, text string"), manifest, blocks, lines, embedder)

    def kept():
        return sorted((r.relative, r.ordinal, r.content, r.embedding[0]) for r in blocks.read().collect())

    def want(**files):
        return sorted((f, i, c, float(len(c))) for f, t in files.items() for i, c in enumerate(t.split("\n")))

    one = {"a": "one\ntwo", "b": "two\nthree", "c": "four"}
    assert run(**one) == {"files": 3, "changed": 3, "gone": 0} and kept() == want(**one)
    base, embedded = seen.value, vectors.value
    assert run(**one) == {"files": 3, "changed": 0, "gone": 0} and seen.value == base
    two = {"a": "one\nfive", "b": "two\nthree", "d": "three"}
    assert run(**two) == {"files": 3, "changed": 2, "gone": 1} and kept() == want(**two)
    assert seen.value > base and vectors.value - embedded <= 2 * 1, "only 'five' is new"
    # A run that died before the manifest was written is done again.
    for f in ("a", "d"):
        manifest.delete(spark.createDataFrame([(f,)], "relative string"))
    assert run(**two)["changed"] == 2 and kept() == want(**two)


def test_vectors_follow_their_text(spark):
    t = spark.createDataFrame([("a", "p", "s", [1.0]), ("b", "q", "t", [2.0])], "_key string, problem string, solution string, embedding array<double>")
    c = spark.createDataFrame([("a", "new", None), ("b", "q", None)], "_key string, problem string, solution string")
    out = incremental.embedded_once(t, c, "_key", ["problem", "solution"], lambda text: F.array(F.length(text).cast("double")))
    assert {r._key: (r.problem, r.embedding) for r in out.collect()} == {"a": ("new", [5.0]), "b": ("q", [2.0])}


# Smaller rules


def test_torn_hosts_are_refused(spark):
    bad = ["http://127.0.0.1\\@8.8.8.8/", "http://8.8.8.8\\x/", "http://a@127.0.0.1@8.8.8.8/", "http://8.8.8.8 @8.8.8.8/"]
    rows = spark.createDataFrame([(u,) for u in [*bad, "http://me@8.8.8.8/", "http://8.8.8.8/a@b@c"]], "u string")
    assert {r.u for r in rows.where(urls.unsafe(F.col("u"))).collect()} == set(bad)
    assert rows.where(urls.unsafe(F.col("u"), ["8.8.8.8"])).count() == len(bad)


def test_iso_times(spark):
    given_ = ["2024-05-01T10:00:00Z", "2024-05-01T10:00:00", "2024-05-01 10:00:00.5", "2024-05-01T12:00:00+02:00", "2024-05-01", "soon", None, ""]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in given_], "t string").select(times.to_iso(times.from_iso(F.col("t")))).collect()]
    assert out == ["2024-05-01T10:00:00.000Z", "2024-05-01T10:00:00.000Z", "2024-05-01T10:00:00.500Z", "2024-05-01T10:00:00.000Z", "2024-05-01T00:00:00.000Z", None, None, None]


def test_checked_inserts_and_tagged_lists(spark):
    schema = "_key string, role string, problem string, solution string, tags array<string>, timestamp timestamp"
    table = spark.createDataFrame([], schema)
    rows = spark.createDataFrame([("1", "dev", "p", "s", ["A", "b"], None), ("2", " ", "p", "s", None, None), ("3", "dev", "p", None, [], None)], schema)
    kept = st.insert_checked(table, rows)
    assert [r._key for r in kept.collect()] == ["1"]
    with pytest.raises(ValueError):
        st.insert_checked(table, rows.withColumn("tags", F.lit("A")))
    with pytest.raises(ValueError):
        st.insert_checked(table, rows.drop("role"))
    text = kept.withColumn("tags", F.to_json("tags"))
    for t, n in (("A", 1), ("b", 1), ("B", 1), ("", 0)):
        assert se.newest(text, ["problem"], "timestamp", "_key", "P", "dev", tags=[t]).count() == n
    assert se.newest(kept, ["problem"], "timestamp", "_key", tags=["A", "b"]).count() == 1


def test_examples_are_written_and_counted(spark, tmp_path):
    rows = spark.createDataFrame([("json", '{"a": 1}'), ("json", "{bad"), ("json", "5"), ("code", "[1]"), ("json", "[1]")], "type string, content string")
    assert ix.write_examples(rows, str(tmp_path / "x")) == 2 == spark.read.json(str(tmp_path / "x")).count()


def test_first_records(spark):
    rows = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("v", 3, None)], "url string, line long, path string")
    assert sorted(map(tuple, st.first_records(rows, "url", "line").collect())) == [("u", 1, "a"), ("v", 3, None)]


def test_rst_files_become_blocks(spark, tmp_path):
    (tmp_path / "a.rst").write_text("Title\n=====\n\nSay this::\n\n    print(1)\n\n.. code-block:: js\n\n    let a\n")
    (tmp_path / "b.rst").write_text("only words\n")
    found, _ = extract.extract_folder(spark, str(tmp_path))
    assert {(r.relative, r.type, r.content, r.language) for r in found.collect()} == {("a.rst", "text", "Say this", None), ("a.rst", "code", "print(1)", "text"), ("a.rst", "code", "let a", "js"), ("b.rst", "text", "only words\n", None)}


def test_previews_and_envelopes(spark):
    docs = spark.createDataFrame([(i, "word " * i, ["t"], [1.0]) for i in range(1, 8)], "doc_id long, text string, tags array<string>, embedding array<double>")
    page = se.bm25(docs, "word", limit=2, offset=1, threshold=0.0)
    shown = se.previewed(page, docs, "doc_id", ["text", "tags"], 10)
    assert shown.columns == [*page.columns, "text", "tags"] and all(r.text.endswith("...") or len(r.text) <= 10 for r in shown.collect())
    one = se.envelope(shown, docs.agg(F.count("*").alias("total")), 2, 1).collect()
    assert len(one) == 1 and [x["rank"] for x in one[0].results] == [2, 3] and one[0].total == 7
    none = se.envelope(page.where("false"), docs.agg(F.count("*").alias("total")), 2, 50).first()
    assert none.results == [] and none.total == 7
    for f in (lambda o: se.keyword_search(docs, ["word"], ["text"], limit=3, offset=o), lambda o: se.tag_search(docs, ["t"], limit=3, offset=o), lambda o: se.substring_search(docs, "word", limit=3, offset=o), lambda o: se.fuzzy_text(docs, ["word"], ["text"], limit=3, offset=o)):
        assert [r["rank"] for r in f(2).orderBy("rank").collect()] == [3, 4, 5]
