"""Filter audit, centroid clustering and word pairs, against plain Python."""

import hashlib
import random
import re
from fractions import Fraction
from itertools import permutations
from math import floor

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import centroids, filter_audit as fa, textkit as tk, word_bpe as wb

# Filter audit


def audited(docs, labels):
    marks = {}
    for i, q, t in labels:
        old = marks.get(i, (0, 0))
        marks[i] = (max(old[0], q == 1), max(old[1], t == 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = {}
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        parts.setdefault(s or "", []).append((fails, marks.get(i, (0, 0)) if i is not None else (0, 0)))
    out = []
    for part, rows in parts.items():
        found, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = lambda x: any(x[g] for g in order[:k])  # noqa: B023, E731
                removed = [m for x, m in rows if x[f] and not gone(x)]
                shapley[f] += len(removed)
                redundant = sum(x[f] and gone(x) for x, _ in rows)
                kept = sum(not x[f] and not gone(x) for x, _ in rows)
                only = sum(x[f] and sum(x.values()) == 1 for x, _ in rows)
                found.append((f, (part, "".join(order), k + 1, kept, len(removed), redundant, only, sum(m[0] for m in removed), sum(m[1] for m in removed))))
        out += [(*row, shapley[f]) for f, row in found]
    return sorted(out)


def odd_documents():
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "bb", "Ab", "c#", "é", "ddd", "日本"]) + str(rng.randrange(300))
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 199, 200, 260]))) for _ in range(25)]
    texts += ["same words " * 150, "x" * 70_000, "", None, "\t\n", "A B", "a" * 49 + "A", "a" * 50 + "A", "a\x0bb\x1cc d"]
    docs = [(i, t, rng.choice(["s1", "s2", None, ""])) for i, t in enumerate(texts)]
    docs += [(100 + i, rng.choice(texts), rng.choice(["s1", "s3"])) for i in range(40)]
    docs += [(None, texts[0], "s1"), (None, None, None), (7, texts[7], "s1"), (7, texts[7], "s1"), (7, texts[8], "s4")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    return docs, labels


def test_audit_of_odd_documents(spark):
    docs, labels = odd_documents()
    frame = spark.createDataFrame([(*d, 1, "x", 2, "y") for d in docs], "doc_id long, text string, source string, id int, part string, mask int, digest string")
    known = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, n int")
    out = fa.filter_audit(frame, known)
    assert sorted(map(tuple, out.collect())) == audited(docs, labels)
    assert fa.filter_audit(frame.limit(0), known).collect() == []
    assert all(r.good_lost == r.toxic_lost == 0 for r in fa.filter_audit(frame, known.limit(0)).collect())


def test_audit_equals_its_sql(spark, tmp_path):
    docs, labels = odd_documents()
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = fa.query(spark, str(tmp_path))
    sql = con.sql(fa.ORACLE)
    assert got.columns == sql.columns and sorted(map(tuple, got.collect())) == sorted(sql.fetchall())


def test_equal_hashes_are_verified(monkeypatch):
    texts = ["ab cd ab ef", "x", "", "same same", "aa bb aa cc bb"]
    data, offs = tk.utf8(pa.array(texts))
    monkeypatch.setattr(tk, "hash_spans", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    n, distinct = fa.words(data, offs)
    assert n.tolist() == [4, 1, 0, 2, 5] and distinct.tolist() == [3, 1, 0, 1, 3]
    place, number = wb.distinct(data, *tk.spans(~tk.SPACE[data], offs))
    starts, ends = tk.spans(~tk.SPACE[data], offs)
    same = lambda i, j: data[starts[i] : ends[i]].tobytes() == data[starts[j] : ends[j]].tobytes()
    assert all(same(i, place[number[i]]) for i in range(len(starts)))


# Centroids


def clustered(rows, k, rounds, dims):
    kept = [(i, [floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    best = lambda v: min(range(len(cs)), key=lambda i: (away(v, cs[i]), i))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(best(v), []).append(v)
        cs = [[sum(x) // len(own[i]) for x in zip(*own[i], strict=True)] if i in own else c for i, c in enumerate(cs)]
    got = [(i, best(v), away(v, cs[best(v)])) for i, v in kept]
    inertia = lambda c: sum(d for _, b, d in got if b == c)
    digest = lambda c: hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()
    return sorted(((i, b, d, inertia(b), sum(x[2] for x in got), digest(b)) for i, b, d in got), key=repr)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_rounds_are_exact(spark, kind):
    rng = random.Random(11)
    point = lambda: [round(rng.choice([-1, 0, 1]) + rng.randrange(-8, 9) / 64, 6) for _ in range(4)]
    rows = [(i, [float(np.float32(x)) for x in point()]) for i in range(150)] + [(1, [0.5] * 4), (1, [0.25] * 4), (None, [-1.0] * 4), (900, [0.5] * 4), (901, [0.5] * 4)]
    rows += [(500, None), (501, []), (502, [1.0] * 3), (503, [1.0] * 5), (504, [1.0, None, 0.0, 0.0]), (505, [float("nan"), 0.0, 0.0, 0.0]), (506, [float("inf"), 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, "x", 3) for r in rows], f"vec_id long, embedding array<{kind}>, id int, vector string, cluster int").repartition(5)
    for k in (1, 7, 400):
        out = centroids.with_inertia(*centroids.lloyd(frame, dims=4, k=k))
        assert sorted(map(tuple, out.collect()), key=repr) == clustered(rows, k, 5, 4)


def test_nothing_to_cluster(spark):
    frame = spark.createDataFrame([(1, None), (2, [0.5])], "vec_id long, embedding array<float>")
    assigned, found = centroids.lloyd(frame)
    assert assigned.columns == ["vec_id", "cluster", "distance"] and assigned.count() == 0 and len(found) == 0
    assert centroids.with_inertia(assigned, found).count() == 0


def test_very_large_components(spark):
    frame = spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in centroids.with_inertia(*centroids.lloyd(frame, dims=2, k=1, rounds=0)).collect()}
    assert max(r.distance for r in out.values()) == 2 * centroids.MOST**2


# Word pairs

ODD = [
    "", None, "Hello  WORLD\n\tit's I'll we've 'tis ''s 's's '", "x's'll!'s 1'd 12 ½ ² A1b2", "ΑΣ Σ ΑΣΑ", "İstanbul é ẞ Ⱥ ⱥ", "日本語テキスト 🐈🐈 ՘ ꟎",
    "<|startoftext|>a<|endoftext|>", "<|STARTOFTEXT|> <|end", "a|<|endoftext|>|", "\x00\x1c\x85  x", "ß µ ª º À×÷ÿ Œœ Ǆǅǆ", "!!??..," * 40, "a" * 3000, "ab" * 2000, "x" * 511 + " " + "y" * 512,
]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(wb.default_path())


@pytest.fixture(scope="module")
def vocabulary():
    return wb.Vocabulary(wb.default_path())


@pytest.mark.parametrize("long", [1, 16, wb.LONG, 10**9])
def test_ids_are_those_of_the_library(library, vocabulary, monkeypatch, long):
    monkeypatch.setattr(wb, "LONG", long)
    rng = random.Random(long)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("etaoin shrdlu's é<|endoftext|>Ab12!?Σ 日") for _ in range(rng.randrange(80))) for _ in range(400)]
    ids, at = wb.Encoder(vocabulary).encode(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want


def test_every_character(library, vocabulary):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 97 == 0 or 0xA700 <= c < 0xAC00 or 0x10900 <= c < 0x11000)]
    texts = ["a" + c + c + "b " + c + "1" for c in chars]
    ids, at = wb.Encoder(vocabulary).encode(pa.array(texts))
    want = library.encode_batch(texts, add_special_tokens=False)
    assert not [hex(ord(chars[i])) for i, e in enumerate(want) if ids[at[i] : at[i + 1]].tolist() != e.ids]


def test_digests_of_texts(spark, library, tmp_path):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "null id", "x", 1), (3, "id again", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, id int")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        e = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(e), sha(" ".join(map(str, e))), sha(library.decode(e, skip_special_tokens=False))))
    assert sorted(map(tuple, wb.query(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
    assert wb.decode(wb.encode(frame.limit(0))).count() == 0


def test_words_come_back(spark):
    frame = spark.createDataFrame([(1, "Hello  wörld, it's 日本 12")], "doc_id long, text string")
    out = wb.decode(wb.encode(frame)).select(wb.readable("decoded").alias("text")).first()
    assert out.text == "hello wörld , it 's 日本 1 2"


def test_memory_of_words_is_given_up(vocabulary, monkeypatch):
    texts = pa.array(["some words here", "and other words"])
    encoder = wb.Encoder(vocabulary)
    one = encoder.encode(texts)[0].tolist()
    monkeypatch.setattr(wb, "KEPT", 0)
    assert encoder.encode(texts)[0].tolist() == one and len(encoder.known) == 2 + 5


class Small(wb.Vocabulary):
    """Merges over a few letters in which 'abc' is made twice and used between, so that places can't all merge at once."""

    def __init__(self):
        merges = [("a", "b"), ("ab", "c"), ("abc", "a"), ("b", "c"), ("a", "bc"), ("a", "a"), ("abc", "abc"), ("c", "c")]
        names = ["a", "b", "c", *dict.fromkeys(x + y for x, y in merges)]
        ids = {n: i for i, n in enumerate(names)}
        self.size, self._table, self.pairs = len(names), None, [(ids[x], ids[y]) for x, y in merges]
        left, right = np.array(self.pairs).T
        self.made = np.array([ids[x + y] for x, y in merges])
        self.rank = np.argsort(left * self.size + right)
        self.keys = (left * self.size + right)[self.rank]
        self.single = wb.unsafe(left, right, self.made, self.size)


def plainly(v, word):
    while True:
        found = [(v.pairs.index(p), i) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in v.pairs]
        if not found:
            return word
        r, i = min(found)
        word = [*word[:i], int(v.made[r]), *word[i + 2 :]]


def test_symbols_used_before_merge_one_at_a_time():
    v, rng = Small(), random.Random(2)
    assert v.single.any() and not v.single.all()
    words = [[rng.randrange(3) for _ in range(rng.randint(1, 14))] for _ in range(600)] + [[0, 1, 2] * 4, [0] * 9]
    offs = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    flat, at = wb.merge_all(v, np.array([x for w in words for x in w]), offs)
    for i, w in enumerate(words):
        assert flat[at[i] : at[i + 1]].tolist() == plainly(v, w) == wb.merge_one(v, np.array(w)).tolist()
