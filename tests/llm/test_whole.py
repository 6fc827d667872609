"""Operators do the whole job: short lines, all segmentations."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import licenses, line_dedup, mixing, pieces, textkit as tk
from tests.llm.test_rows import MODEL, every_path, small_vocabulary


def test_short_lines_are_judged(spark, tmp_path):
    rng = random.Random(5)
    pool = [" ".join(f"v{rng.randrange(40)}" for _ in range(rng.randint(1, 9))) for _ in range(50)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(100, "A b\n\n \t\n a  B \nb a\na b c"), (101, "a b\n\na\tb\tc"), (102, None), (103, "")]
    sets = {}
    for i, t in rows:
        for at, x in enumerate((t or "").split("\n")):
            w = [v for v in re.split(r"[\x20\x09-\x0D]+", x.lower()) if v]
            if w:
                sets[i, at] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    gone = {b for b in sets for a in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    want = {i: None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if (i, at) not in gone) for i, t in rows}
    assert want[100] == "A b\n\n \t\nb a\na b c" and want[101] == ""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(df, short=True).collect()} == want
    # The registered query and its SQL.
    df.where("text is not null").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = line_dedup.query_all_lines(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert line_dedup.ORACLE_ALL_LINES != line_dedup.ORACLE
    assert sorted(map(tuple, got)) == sorted(con.sql(line_dedup.ORACLE_ALL_LINES).fetchall())


def applied(ids, changes):
    out = list(ids)
    for at, n, new in reversed(changes):
        out[at : at + n] = np.frombuffer(new, np.int32).tolist()
    return out


@pytest.mark.parametrize("long", [pieces.LONG, 1])
def test_all_segmentations_of_texts(monkeypatch, long):
    monkeypatch.setattr(pieces, "LONG", long)
    v, rng = small_vocabulary(), random.Random(7)
    texts = ["ab ba", "bab  ab a", "ab ab ab", "é x", "", " ", "xé ab", "a"] + ["".join(rng.choice("ab éx") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    data, offs = tk.utf8(pa.array(texts))
    for text, (ids, score, scores, changes) in zip(texts, pieces.Encoder(v, 6).segmentations(data, offs), strict=True):
        made = [tuple(applied(ids, x)) for x in changes]
        assert made[0] == tuple(ids) and len(set(made)) == len(made) == len(scores)
        assert all(pieces.decode(v, x) == text.encode() for x in made)
        if text:
            assert np.allclose(scores, every_path(v, b" " + text.encode())[:6])
        # Bytes stand for an uncovered character, which has one score.
        assert all(np.isclose(s, sum(v.score[i] for i in x if i >= 256) + v.unknown * text.count("x")) for s, x in zip(scores, made, strict=True))


def test_one_segmentation_only():
    v = small_vocabulary()
    data, offs = tk.utf8(pa.array(["ab ba"]))
    (ids, score, scores, changes), *_ = pieces.Encoder(v, 1).segmentations(data, offs)
    assert scores == [score] and changes == [[]]


@pytest.mark.skipif(not MODEL.exists(), reason="no vocabulary file")
def test_each_segmentation_decodes_to_its_text(spark):
    texts = ["Hello  World\nfoo\tbar é", "", None, "▁mark▁ <0x0A> ", "猫と犬 🐈", "x" * 500, " ", "the same same same word"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pieces.encode(rows).cache()
    found = pieces.segmentations(out).cache()
    assert found.count() == sum(len(r.nbest_scores) for r in out.collect()) > 3 * 5
    assert found.select("doc_id", "ids").distinct().count() == found.count()
    back = pieces.decode_rows(found.selectExpr("10 * doc_id + rank as doc_id", "ids")).collect()
    assert all(r.text == (texts[r.doc_id // 10] or "") for r in back)


def test_only_the_boundary_bucket_is_summed_again(spark):
    rows = [(s, i + 1, i << 22) for s in ("a", None) for i in range(64)]
    sized = spark.createDataFrame(rows, "source string, size long, h long")
    found = spark.createDataFrame([("a", 3, 1), (None, 0, 1)], "source string, prefix long, left long")
    assert mixing.boundary(sized, found, 0).count() == len(rows)
    want = sorted(((s, n, h >> 12) for s, n, h in rows if h >> 24 == (3 if s else 0)), key=str)
    assert sorted(map(tuple, mixing.boundary(sized, found, 1).collect()), key=str) == want and len(want) == 8


def test_the_unlicense_matches_by_its_name(spark):
    rows = spark.createDataFrame([(1, "This is The Unlicense."), (2, "the unlicense license")], "doc_id long, text string")
    assert {r.doc_id: (r.labels, r.score) for r in licenses.scan(rows).collect()} == {1: ("unlicense", 0.8), 2: ("unlicense", 0.8)}


def test_a_mix_repeats_rows_not_ids(spark):
    """An id in two sources is taken from each as often as that source says; other columns stay, even if named alike."""
    rows = [(1, "x " * 9, "a", 1), (1, "x " * 9, "b", 2), (2, None, None, 3), (None, "y", "b", 4)] + [(i, "x y z", "a" if i % 2 else "b", i) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    want = Counter({(r.doc_id, r.size, r.source_size): 0 for r in mixing.mix(df).collect()})
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.size, r.source_size] += r.copies
    sizes = {s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in ("a", "b", None)}
    got = mixing.repeated(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, len((r.text or "").split()), sizes[r.source]) for r in got.collect()) == Counter({k: n for k, n in want.items() if n})
    assert mixing.repeated(df.limit(0)).count() == 0
