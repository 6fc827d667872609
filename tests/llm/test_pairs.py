"""Similarity joins and near-duplicate operators against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import components as cc, line_dedup, ngram_join as nj, suffix_dedup as sd, textkit as tk, vector_dedup as vd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=160, seed=5, words=40):
    """Documents with exact and near copies, shared passages, empty, null and long ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, words))] for _ in range(n // 4)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        t = " ".join(w)
        if rng.random() < 0.2:
            t += "\n" + passage + "\n" + t.upper()
        texts.append(t)
    texts += [None, "", "  \n\t", "one", "ONE", "one two", passage * 40, passage, passage]
    rng.shuffle(texts)
    return [(i * 3, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def union(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(spark, k, num):
    rows = corpus()
    sets = {r[0]: shingle_set(r[1], k) for r in rows}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = {i: (len(sets[i]), c) for i, c in union(pairs, ids).items()}
    got = nj.ngram_jaccard_join(spark.createDataFrame(rows, DOCS), k=k, num=num, den=100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_ngram_join_in_many_blocks(spark, monkeypatch):
    """Groups over the bounds of a block are split and lose no link."""
    monkeypatch.setattr(nj, "BLOCK", 3)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(50):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w[: rng.choice([54, 57, 60])]), "en", "s", 0))
    sets = {r[0]: shingle_set(r[1], 3) for r in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    got = nj.ngram_jaccard_join(spark.createDataFrame(rows, DOCS), k=3, num=90, den=100)
    assert {r.doc_id: r.component_id for r in got.collect()} == union(pairs, sorted(sets))


def test_ngram_join_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert nj.ngram_jaccard_join(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c", "x"), (1, "a b c", "y"), (1, "a b c", "y"), (2, "A  B\tC", "z")], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_jaccard_join(odd).collect()), key=str)
    assert got == sorted([(None, 1, None), (1, 1, 1), (1, 1, 1), (2, 1, 1)], key=str)


def test_ngram_join_rows_that_share_an_id(spark):
    """An id with two texts joins the components of both."""
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(4, a), (4, b), (2, a), (7, b), (9, "x"), (4, a), (8, "x y"), (8, "x  Y")]
    got = nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(2, 2), (4, 2), (4, 2), (4, 2), (7, 2), (8, 8), (8, 8), (9, 9)]


@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=90, unique=True), st.lists(st.integers(0, 2**63), min_size=1, max_size=90, unique=True), st.integers(0, 80))
@settings(max_examples=100, deadline=None)
def test_parities_differ_in_no_more_bits_than_elements(a, b, both):
    a, b = (np.unique(np.array(x, dtype=np.uint64)) for x in (a, b + a[:both]))
    x, y = nj.sketch(a), nj.sketch(b)
    words = min(len(x), len(y))
    assert int(np.bitwise_count(nj.fold(x, words) ^ nj.fold(y, words)).sum()) <= len(np.setxor1d(a, b))
    shared, apart = len(np.intersect1d(a, b)), nj.most_apart(np.array([len(a)]), np.array([len(b)]), 80, 100)[0]
    if 100 * shared >= 80 * (len(a) + len(b) - shared):
        assert len(np.setxor1d(a, b)) <= apart


@given(st.lists(st.integers(0, 2**63), min_size=10, max_size=80, unique=True), st.integers(0, 7), st.randoms())
@settings(max_examples=80, deadline=None)
def test_linked_sets_share_a_signature(items, edits, rng):
    num, den = 80, 100
    sizes = nj.Sizes(num, den)
    a = np.sort(np.array(items, dtype=np.uint64))
    b = list(items)
    for _ in range(edits):
        b[rng.randrange(len(b))] = rng.getrandbits(63)
    b = np.unique(np.array(b, dtype=np.uint64))
    shared = len(np.intersect1d(a, b))
    if den * shared >= num * (len(a) + len(b) - shared) and not np.array_equal(a, b):
        assert len(np.intersect1d(nj.signatures(a, sizes), nj.signatures(b, sizes)))


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    nodes = sorted({x for e in chain for x in e})
    want = union([e for e in chain if e[0] != e[1]], nodes)
    assert got == {n: want[n] for n in nodes if n in got} and set(nodes) - set(got) <= {n for n in nodes if want[n] == n}
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_forest():
    nodes, roots = tk.forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {1: 1, 3: 1, 5: 1, 8: 8, 9: 8}


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((12, 16))
    rows = []
    for i in range(300):
        v = centre[rng.integers(12)] + rng.choice([0.0, 0.05, 0.4]) * rng.standard_normal(16)
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.5, 3)], int(rng.integers(3))))
    rows += [(400 + j, rows[0][1], rows[0][2]) for j in range(5)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, rows[0][1], None), (504, [1.0, 2.0], 1), (505, [2.0, 4.0], 1), (506, [], 1), (507, [None] + [1.0] * 15, 1), (508, [float("inf")] * 16, 1)]
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vd, "BLOCK", block)
    monkeypatch.setattr(vd, "SLICE", 2 * block)
    rows = vectors()
    ok = {i: (np.array(v, dtype=float), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(r[0] for r in rows)
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] / np.linalg.norm(ok[a][0]) / np.linalg.norm(ok[b][0]) >= 0.98]
    comp = union(links, ids)
    count = {i: 0 for i in ids}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = vd.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == {i: (count[i], comp[i], comp[i] == i) for i in ids}
    assert len(links) > 300
    assert vd.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


@pytest.mark.parametrize("sent", [50_000, 0])
def test_probed_lists_are_never_broadcast(spark, monkeypatch, sent):
    """Spark takes the rows of the exploded probes for fewer bytes than they are, and the sizes of the lists for more as soon as a
    part of them is broadcast; the sizes go to every task if they are few."""
    plans = {}

    def seen(df, name, write=vd.materialize):
        df.collect()  # joins are chosen anew while it runs
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    rows = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    want = sorted(vd.near_vectors(rows).collect())
    monkeypatch.setattr(vd, "materialize", seen)
    monkeypatch.setattr(vd, "SENT_LISTS", sent, raising=False)
    monkeypatch.setattr(vd, "SLICE", 64)
    assert sorted(vd.near_vectors(rows).collect()) == want
    assert "BuildLeft" not in plans["found"] and "Broadcast" not in plans["members"] + plans["representatives"]
    joins = re.findall(r"(Broadcast\w+Join|SortMergeJoin|ShuffledHashJoin) \[.*", plans["found"])
    assert set(joins) == {"BroadcastHashJoin" if sent else "SortMergeJoin"}


def line_brute(rows, k=5, num=80, den=100):
    lines = [(i, at, x) for i, t in rows if t is not None for at, x in enumerate(t.split("\n"))]
    sets = {}
    for i, at, x in lines:
        w = [v for v in re.split(r"[\x20\x09-\x0D]+", x.lower()) if v]
        if len(w) >= k:
            sets[i, at] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    gone = {b for b in sets for a in sets if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
    return {i: None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if (i, at) not in gone) for i, t in rows}


def test_line_dedup(spark):
    rng = random.Random(4)
    pool = [" ".join(f"v{rng.randrange(300)}" for _ in range(rng.randint(3, 40))) for _ in range(60)]

    def edited(line):
        w = line.split(" ")
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "zz"
        return " ".join(w)

    rows = [(i * 2, "\n".join(edited(rng.choice(pool)) for _ in range(rng.randint(0, 9)))) for i in range(80)] + [(900, None), (901, ""), (902, "\n\n"), (903, "\n".join([pool[0]] * 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as at", "2 as tokens", "3 as n_removed")
    got = line_dedup.line_dedup(df)
    assert {r.doc_id: r.text for r in got.collect()} == line_brute(rows)
    assert got.columns == ["doc_id", "at", "tokens", "text", "n_lines", "n_removed"]
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_null_and_repeated_ids(spark):
    line = "a b c d e f g"
    rows = spark.createDataFrame([(None, line), (3, line), (3, line), (1, "x\n" + line)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.line_dedup(rows).collect()), key=str)
    assert got == sorted([(None, ""), (3, ""), (3, ""), (1, "x\n" + line)], key=str)


def test_line_dedup_drops_emptied_documents(spark):
    rows = [(1, "a b c d e f\nx\n"), (2, "a b c d e f\n \nx"), (3, " \n"), (4, None), (5, ""), (6, "x\nnew"), (None, "x"), (2, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with pytest.raises(ValueError):
        line_dedup.line_dedup(docs, drop_emptied=True)
    out = line_dedup.line_dedup(docs, short=True).collect()
    want = [r for r in out if r.n_removed == 0 or (r.text or "").strip()]
    got = line_dedup.line_dedup(docs, short=True, drop_emptied=True).collect()
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert sorted(got, key=order) == sorted(want, key=order) and [r.doc_id for r in sorted(got, key=order)] == [1, 3, 4, 5, 6]


def test_vectors_of_any_magnitude(spark):
    rows = [(i, [f * 1.0, f * 2.0], "a") for i, f in enumerate((1.0, 1e-170, 1e160, 5e-324))] + [(9, [2e300, -1e300], "a"), (10, [0.0, 0.0], "a")]
    got = {r.vec_id: r.n_links for r in vd.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 3, 9: 0, 10: 0}


def test_line_dedup_rows_that_share_an_id(spark):
    """Rows of one id with different texts are judged line by line, not as one."""
    a, b = "a b c d e f", "p q r s t u"
    rows = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (None, a), (None, "n1 n2 n3 n4 n5"), (None, "n1 n2 n3 n4 n5 \n x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup.line_dedup(rows).collect()), key=str)
    one, two = ((None, "n1 n2 n3 n4 n5", 0), (None, " x", 1)), ((None, "", 1), (None, "n1 n2 n3 n4 n5 \n x", 0))  # by the hash of their texts
    rest = [(1, a, 0), (2, "", 1), (2, b, 0), (3, "", 1), (None, "", 1)]
    assert got in (sorted([*rest, *one], key=str), sorted([*rest, *two], key=str))


@pytest.mark.parametrize("edits", [3, 6])
def test_line_dedup_in_a_family(spark, edits):
    """Many near copies of one line, some covered by its first line and some by others only."""
    rng = random.Random(edits)
    base = [f"b{i}" for i in range(50)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.choice([3, 20, 41, rng.randrange(50)])] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.text for r in got.collect()} == line_brute(rows)


def repeats_brute(rows, width=50):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        starts = []
        for s in range(len(b) - width + 1):
            if seen.setdefault(b[s : s + width], i) < i:
                starts.append(s)
        gone = np.zeros(len(b), bool)
        for s in starts:
            gone[s : s + width] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def repeating(seed=6):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcé \n") for _ in range(n))
    passages = [text(rng.randint(45, 200)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice([text(rng.randint(0, 60)), rng.choice(passages)]) for _ in range(rng.randint(0, 5))]
        rows.append((i * 5, "".join(parts)))
    return rows + [(1001, rows[3][1]), (1002, rows[3][1]), (1003, "ab" * 400), (1004, "ab" * 90), (1005, "a" * 300), (1006, "a" * 49), (1007, "a" * 50), (1008, ""), (1009, None), (1010, "\0" * 60 + "x"), (1011, "y" + "\0" * 60)]


def test_remove_repeats(spark):
    rows = repeating()
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    want = repeats_brute(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    assert sum(r.n_removed for r in got) > 3000


def test_remove_repeats_edges(spark):
    schema = "doc_id long, text string"
    assert sd.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    t = "q" * 30 + "r" * 30
    got = sorted((str(r.doc_id), r.n_removed) for r in sd.remove_repeats(spark.createDataFrame([(None, t), (2, t), (2, t), (5, t)], schema)).collect())
    assert got == [("2", 0), ("2", 0), ("5", 60), ("None", 0)]


@given(st.lists(st.text("abc", min_size=1, max_size=25), min_size=1, max_size=12), st.sampled_from([20, 60, 1000]))
@settings(max_examples=150, deadline=None)
def test_merged_intervals(strings, shard):
    """Two suffixes share an interval exactly when their first 6 symbols are there and equal."""
    raw = np.frombuffer("".join(strings).encode(), np.uint8)
    size = np.array([len(x) for x in strings])
    place, interval = sd.repeated(raw, size, shard=shard, depth=6)
    first = np.concatenate(([0], np.cumsum(size + 1)))
    assert sorted(place.tolist()) == list(range(first[-1]))
    by_interval, by_content = {}, {}
    for p, i in zip(place.tolist(), interval.tolist(), strict=True):
        k = int(np.searchsorted(first, p, side="right")) - 1
        part = strings[k][p - first[k] : p - first[k] + 6]
        name = part if len(part) == 6 else (k, p)
        by_interval.setdefault(i, set()).add(name)
        by_content.setdefault(name, set()).add(i)
    assert all(len(v) == 1 for v in (*by_interval.values(), *by_content.values()))


def test_lines_of_the_index_get_their_places_once(spark, monkeypatch):
    """The index holds the places, so that no later join fetches them again; the verified sets are neither ranked nor boxed."""
    made, table = {}, line_dedup.Table
    monkeypatch.setattr(line_dedup, "Table", lambda df, name: made.setdefault(name, table(df, name)))
    rows = [(i, f"a b c d e f g h i j k l m n o p q r s t u v w x y{i}") for i in range(4)] + [(9, "p q r s t u")]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in out.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 9: 0}
    assert made["met"].df.columns == ["token", "b"] and made["met"].df.select("b.*").columns == ["id", "th", "at", "line", "n", "i"]
    assert made["fetched"].df.columns == ["line", "tokens"]
    for short in (False, True):
        sets = spark.createDataFrame([("a b c d e f",), ("a b",), (" ",)], "line string").select(line_dedup.tokens(F.col("line"), 5, short).alias("t"))
        assert not sets.select(F.array_distinct("t").alias("t")).schema["t"].dataType.containsNull
        assert all(0 <= t < 1 << line_dedup.HASH_BITS for r in sets.collect() for t in r.t)


def test_only_lines_that_can_have_a_partner_are_counted_and_ranked(spark, monkeypatch):
    """Lines that share no token of their prefixes are settled by hash alone; whole texts aren't split for the counts of tokens."""
    counted, classes = [], line_dedup._classes
    monkeypatch.setattr(line_dedup, "_classes", lambda token: counted.append(token.count()) or classes(token))
    monkeypatch.setattr(line_dedup, "rarity_classes", None)
    passage = " ".join(f"p{i}" for i in range(12))
    lone = [" ".join(f"w{i}_{j}" for j in range(30)) for i in range(40)]
    rows = [(i, line) for i, line in enumerate(lone)] + [(100 + i, f"{passage} {' '.join(f'x{j}' for j in range(20))} y{i}") for i in range(3)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.collect() if r.n_removed} == {101, 102}
    assert counted == [3 * 29]
    # A passage that stands in many lines, by hash in the prefixes of some: still no line is lost.
    rows = [(i, f"{line} {passage}") for i, line in enumerate(lone)] + [(200 + i, f"{line} {passage} z") for i, line in enumerate(lone[:5])]
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == line_brute(rows)


def test_lines_are_ranked_without_nulls_and_counted_like_their_tokens(spark):
    """Keys that may be null are sorted as objects; odd blanks don't change a line's words."""
    lines = ["a b c d e f", " a  b\tc d\x0be f\r", "a b c d e f\x0c", "x y", "  ", "", "A b c d e f g", "a b c d e a b c d e a b c d e"]
    rows = spark.createDataFrame([(1, 1, "\n".join(lines))], "id long, th long, lowered string")
    for short in (False, True):
        made = line_dedup._lines(rows, 5, short).select("at", line_dedup.tokens(F.col("line"), 5, short).alias("t"))
        counts = [0] * line_dedup.BUCKETS
        for r in made.collect():
            for t in r.t:
                counts[t & (line_dedup.BUCKETS - 1)] += 1
        got = line_dedup.rarity_classes(rows, 5, short)
        assert got == [min(127, 1 + int(4 * math.log2(n))) if n else 0 for n in counts]
        ranked = made.sparkSession.createDataFrame(list(enumerate(lines)), "at long, line string").select("at", line_dedup.ranked(F.col("line"), 5, got, short).alias("r"))
        assert not ranked.schema["r"].dataType.containsNull
        sets = {r.at: r.r for r in ranked.collect()}
        assert sets[0] == sets[1] == sets[2] and len(sets[0]) == 2 and len(sets[7]) == 5 and all(s == sorted(set(s)) for s in sets.values())
        assert [len(sets[i]) for i in (3, 4, 5)] == [int(short), 0, 0]
