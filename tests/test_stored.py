"""Stored tables, indexes on files and streams with state."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import stems
from quillspark.operators import postings as po, search as se, stored, vectors as ve
from quillspark.streaming import state

KEYED = "k string, v long"


def shown(table):
    return sorted(map(tuple, table.read().collect()))


def test_changes_of_a_stored_table(spark, tmp_path):
    t = stored.StoredTable.create(spark, f"file://{tmp_path}/t", KEYED, "k", 8)
    assert shown(t) == []
    rows = lambda *r: spark.createDataFrame(r, KEYED)
    t.upsert(rows(*[(f"k{i}", i) for i in range(50)], ("k1", 7), ("k1", 5)), order="v")
    assert dict(shown(t))["k1"] == 7 and len(shown(t)) == 50
    before = t.state()["version"]
    t.upsert(rows(("k2", 100), ("new", 1), (None, 3)))
    assert dict(shown_not_null(t)) == {f"k{i}": i for i in range(50)} | {"k1": 7, "k2": 100, "new": 1}
    assert t.get("new").collect()[0].v == 1 and t.get("none").count() == 0
    assert len([p for b, p in t.state(before)["paths"].items() if t.state()["paths"][b] != p]) <= 3, "only touched buckets are written"
    t.delete(rows(("k3", 0), ("unknown", 0)))
    assert "k3" not in dict(shown_not_null(t))
    assert dict(map(tuple, t.read(before).collect()))["k3"] == 3, "an older snapshot stays whole"
    t.clean(keep=1)
    assert "k3" not in dict(shown_not_null(t)) and len(t.snapshots()) == 1
    with pytest.raises(TypeError):
        stored.StoredTable.create(spark, f"file://{tmp_path}/t", "k string, v int", "k")
    assert shown_not_null(stored.StoredTable.create(spark, f"file://{tmp_path}/t", KEYED, "k")) == shown_not_null(t)


def shown_not_null(t):
    return [r for r in map(tuple, t.read().where("k is not null").collect())]


def test_a_writer_that_dies_before_its_snapshot_changes_nothing(spark, tmp_path, monkeypatch):
    t = stored.StoredTable.create(spark, f"file://{tmp_path}/t", KEYED, "k", 4)
    t.upsert(spark.createDataFrame([("a", 1)], KEYED), stream="s", batch=0)
    real = stored.Folder.create
    monkeypatch.setattr(stored.Folder, "create", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        t.upsert(spark.createDataFrame([("a", 2), ("b", 2)], KEYED), stream="s", batch=1)
    monkeypatch.setattr(stored.Folder, "create", real)
    assert shown(t) == [("a", 1)] and len(t.folder.names()) == 4
    assert len(t.clean()) == 1
    t.upsert(spark.createDataFrame([("a", 2), ("b", 2)], KEYED), stream="s", batch=1)
    assert shown(t) == [("a", 2), ("b", 2)]
    version = t.upsert(spark.createDataFrame([("a", 9)], KEYED), stream="s", batch=1)
    assert version == t.state()["version"] and shown(t) == [("a", 2), ("b", 2)], "a repeated batch changes nothing"


def test_two_writers_of_one_snapshot(spark, tmp_path):
    t = stored.StoredTable.create(spark, f"file://{tmp_path}/t", KEYED, "k", 4)

    def slow(rows, new):
        stored.StoredTable(spark, f"file://{tmp_path}/t").upsert(spark.createDataFrame([("other", 1)], KEYED))
        return new

    with pytest.raises(stored.Conflict):
        t.change(spark.createDataFrame([("a", 1)], KEYED), slow)
    assert shown(t) == [("other", 1)]


def test_a_stream_that_breaks_off_after_its_snapshot(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1), ("b", 1)], KEYED).coalesce(1).write.json(str(source))
    t = stored.StoredTable.create(spark, f"file://{tmp_path}/t", "k string, v long", "k", 4)
    add = lambda rows, new: rows.unionByName(new).groupBy("k").agg(F.sum("v").alias("v"))
    stream = lambda: spark.readStream.schema(KEYED).json(str(source)).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)

    def dies(rows, batch):
        t.change(rows, add, "adds", batch)
        raise RuntimeError("killed after the snapshot")

    with pytest.raises(Exception, match="killed"):
        stream().foreachBatch(dies).start().awaitTermination(60)
    assert shown(t) == [("a", 1), ("b", 1)]
    stream().foreachBatch(lambda rows, batch: t.change(rows, add, "adds", batch) and None).start().awaitTermination(60)
    assert shown(t) == [("a", 1), ("b", 1)], "the repeated batch is known by its number"
    spark.createDataFrame([("a", 2)], KEYED).coalesce(1).write.mode("append").json(str(source))
    stored.upsert_stream(spark.readStream.schema(KEYED).json(str(source)), t, str(tmp_path / "c2"), "upserts", "v", once=True).start().awaitTermination(60)
    assert shown(t) == [("a", 2), ("b", 1)]
    # By the clock: rows show up a batch at a time.
    spark.createDataFrame([("c", 3)], KEYED).coalesce(1).write.mode("append").json(str(source))
    running = stored.upsert_stream(spark.readStream.schema(KEYED).json(str(source)), t, str(tmp_path / "c2"), "upserts", "v", every="200 milliseconds").start()
    until = time.time() + 40
    while time.time() < until and ("c", 3) not in shown(t):
        time.sleep(0.3)
    running.stop()
    assert ("c", 3) in shown(t)


def events(spark, path, rows):
    spark.createDataFrame(rows, "job string, status string, ts timestamp, tie long").coalesce(1).write.mode("append").parquet(path)


def run(df, tmp_path, name):
    out = []
    writer = df.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True)
    writer.foreachBatch(lambda rows, batch: out.extend(map(tuple, rows.collect()))).start().awaitTermination(120)
    return out


def test_jobs_time_out_and_survive_a_restart(spark, tmp_path):
    state.use_rocksdb(spark)
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    path = str(tmp_path / "events")
    events(spark, path, [("a", "pending", at(0), 1), ("a", "running", at(1), 2), ("b", "pending", at(0), 3), ("b", "completed", at(1), 4), ("c", "pending", at(0), 5), ("c", "running", at(2), 6), ("c", "completed", at(3), 7)])
    stream = lambda: state.job_machine(spark.readStream.schema("job string, status string, ts timestamp, tie long").parquet(path), 600_000, "1 minute")
    first = run(stream(), tmp_path, "c")
    assert {(r[0], r[1], r[4]) for r in first} == {("a", "pending", None), ("a", "running", None), ("b", "pending", None), ("b", "pending", "refused: completed"), ("c", "pending", None), ("c", "running", None), ("c", "completed", None)}
    assert [r[2:4] for r in first if r[:2] == ("c", "completed")] == [(at(2), at(3))]
    # After a restart the state is still there; news of d moves the watermark past a's and b's ends.
    events(spark, path, [("d", "pending", at(30), 8)])
    events(spark, path, [("d", "running", at(31), 9)])
    later = run(stream(), tmp_path, "c")
    assert {(r[0], r[1], r[4]) for r in later if r[0] in "abc"} == {("a", "failed", "timed out"), ("b", "failed", "timed out")}
    assert [r[2] for r in later if r[0] == "a"] == [at(1)]
    events(spark, path, [("a", "running", at(32), 10), ("a", "pending", at(33), 11)])
    last = run(stream(), tmp_path, "c")
    assert {(r[1], r[4]) for r in last if r[0] == "a"} == {("failed", "refused: running"), ("pending", None)}


def test_a_visited_key_never_returns(spark, tmp_path):
    state.use_rocksdb(spark)
    path = str(tmp_path / "in")
    write = lambda *urls: spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, n long").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: state.visited_once(spark.readStream.schema("url string, n long").parquet(path), "url")

    def new():
        out = []
        writer = stream().writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        writer.foreachBatch(lambda rows, batch: out.extend(r.url for r in rows.collect())).start().awaitTermination(120)
        return sorted(out)

    write("x", "y", "x")
    assert new() == ["x", "y"]
    write("y", "z", "x")
    assert new() == ["z"]
    write("x", "y", "z")
    assert new() == []


# Indexes


def documents(spark, n=300):
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["licensed", "licensing", "license", "Éa"]
    rows = [(i, " ".join(["hot", *(rng.choice(words) for _ in range(rng.randrange(40)))]), rng.choice(["x y", None])) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, None), (n + 1, "", "--"), (n + 2, "a b a b a", "b a")], "doc_id long, text string, more string")


def ranked(df):
    return [(r.doc_id, round(r.score, 8), r["rank"]) for r in sorted(df.collect(), key=lambda r: r["rank"])]


def test_an_index_finds_what_a_scan_finds(spark, tmp_path):
    docs = documents(spark)
    index = po.build(docs, f"file://{tmp_path}/i", fields=("text", "more"), buckets=5)
    assert index.n == docs.count()
    for query in ("hot", "w1 w2", "hot w3 license", "license licensed w9", "nothing here", "", "Éa HOT"):
        a, b = po.bm25(index, query, 7, 2), se.bm25(docs, query, fields=("text", "more"), limit=7, offset=2)
        assert ranked(a) == ranked(b) and {r.total for r in a.collect()} == {r.total for r in b.collect()}
        for k in (1, 5, 1000):
            found, bands = po.best(index, query, k)
            assert ranked(found) == ranked(po.bm25(index, query, k, threshold=0.0)), (query, k)
    assert po.best(index, "hot", 3)[1] != list(range(len(po.BANDS))), "the low bands of one term aren't read"
    with pytest.raises(ValueError):
        po.phrase(index, "hot")
    plan = index.postings(["hot"])._jdf.queryExecution().toString()
    assert "In(term" in plan or "EqualTo(term" in plan


def test_phrases_and_stems(spark, tmp_path):
    docs = documents(spark)
    index = po.build(docs, f"file://{tmp_path}/i", fields=("text", "more"), buckets=3, positions=True)
    rows = {r.doc_id: se.tx_tokens(f"{r.text or ''} {r.more or ''}") for r in docs.collect()}
    for words in ("a b", "a b a", "a a", "hot w1", "b b a", "w2"):
        w = words.split()
        want = {i: n for i, t in rows.items() if (n := sum(t[j : j + len(w)] == w for j in range(len(t))))}
        assert {r.doc_id: r.n for r in po.phrase(index, words).collect()} == want
    # Stemmed search is a search in stemmed texts.
    stemmed = docs.select("doc_id", F.array_join(F.transform(F.split(F.lower(F.concat_ws(" ", "text", "more")), r"[^\p{L}\p{N}]+"), stems.stem), " ").alias("text"))
    assert ranked(po.bm25(index, "licenses w1", 20, stemmed=True)) == ranked(se.bm25(stemmed, "licens w1", limit=20))


def test_an_empty_index(spark, tmp_path):
    index = po.build(documents(spark).limit(0), f"file://{tmp_path}/i", positions=True)
    assert po.bm25(index, "a").collect() == [] and po.best(index, "a")[0].collect() == [] and po.phrase(index, "a b").collect() == []


def test_parts_of_the_index_follow_the_bytes_of_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(po, "PART_BYTES", 200)
    docs = spark.range(400).selectExpr("id doc_id", "concat('the w', id % 7, ' the \u00e9t\u00e9 w', id) text")
    index = po.build(docs, f"file://{tmp_path}/i", positions=True)
    rows = spark.read.parquet(f"{tmp_path}/i/postings")
    spread = rows.withColumn("part", F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1)).groupBy("part").count()
    assert rows.count() == 400 * 4 - 7
    assert spread.agg(F.max("count")).first()[0] < 200
    assert {r.doc_id for r in po.phrase(index, "the \u00e9t\u00e9").collect()} == set(range(400))


def test_an_index_follows_its_table(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(1, "one fish")], "doc_id long, text string").write.parquet(path)
    one = po.ensure(spark, path)
    assert po.ensure(spark, path).folder == one.folder
    spark.createDataFrame([(2, "two fish")], "doc_id long, text string").write.mode("append").parquet(path)
    assert [r.doc_id for r in po.bm25(po.ensure(spark, path), "fish").collect()] == [1, 2]


# Fixed values of the published algorithm.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration digitizer digit differently differ vileli vile vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electrical electr hopeful hope goodness good revival reviv
allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adoption adopt communism commun activate activ
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil is is ab ab x1s x1s""".split()


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    got = spark.createDataFrame(pairs, "w string, want string").select("w", "want", stems.stem(F.col("w")).alias("got")).collect()
    assert [(r.w, r.got) for r in got if r.got != r.want] == []


def test_nearest_vectors_from_few_lists(spark, tmp_path):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 8))
    x = np.repeat(middle, 60, axis=0) + 0.05 * rng.normal(size=(720, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(800, x[3].tolist()), (900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [None] * 8), (905, [1.0] * 3)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ve.build(docs, f"file://{tmp_path}/v", lists=24)
    read = []
    for i in (3, 100, 250, 400, 700):
        found, n = index.nearest(x[i], 10)
        read.append(n)
        assert ranked_vectors(found) == ranked_vectors(se.semantic(docs.where("vec_id not in (904, 903)"), x[i].tolist(), limit=10, threshold=-1.0))
    assert sum(read) / len(read) < 12
    assert index.nearest(x[3], 10_000)[1] == len(index.lists)
    with pytest.raises(ValueError):
        index.nearest([0.0] * 8)
    empty = ve.build(docs.limit(0), f"file://{tmp_path}/e")
    assert len(empty.lists) == 0


def ranked_vectors(df):
    return [(r.vec_id, round(r.score, 9), r["rank"]) for r in sorted(df.collect(), key=lambda r: r["rank"])]
