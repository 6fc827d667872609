"""Byte-pair encoding of words by batched merge rounds, and decoding.

The vocabulary file is one of a public library of tokenizers: NFC, white space as one blank, lower case; special tokens
found in the raw text; words by a pattern; bytes as characters; merges inside a word whose last symbol carries a mark.

The distinct words of an Arrow batch lie in one flat array of symbols.  A round takes, in every word that still has a
pair to merge, the pair of lowest rank, merges its places from the left, and looks the new neighbours' ranks up by binary
search over the sorted pair keys.  All places of a pair may merge in one round unless the symbol made takes part in an
earlier merge; such pairs (found when the vocabulary is loaded) merge one place a round.  Words of ``LONG`` bytes and more
merge by a heap over linked symbols instead, by the same rule and with the same ids, as a round looks at a whole word.

A null text counts as empty and has no ids; null and repeated doc ids are rows like any other; texts may be of any length;
an empty table gives an empty result.  Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.shared import bound_batches

FILE = "word_bpe_49k.json"
#: Bytes of a word from which it merges by a heap; both ways give the same ids.
LONG = 512
#: Bytes of words whose ids a task keeps for its next batches.
KEPT = 32 << 20
NEVER = np.iinfo(np.int64).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def later_lower() -> dict[int, int]:
    """Lower case of capitals newer than Python's tables (first, last, its lower case): fixed values of Unicode 16 and 17."""
    ranges = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3)]
    ranges += [(0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
    return {c: low + c - a for a, b, low in ranges for c in range(a, b + 1) if chr(c).lower() == chr(c)}


#: Letters and numbers of the regex module that Unicode 16, on which the library stands, doesn't have (first, last): fixed values.
NEWER = [
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f), (0x209d, 0x209f), (0xa7ce, 0xa7cf),
    (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2), (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf),
    (0x10940, 0x10959), (0x10ec5, 0x10ec7), (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11de0, 0x11de9),
    (0x11df1, 0x11df1), (0x1246f, 0x1246f), (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3),
    (0x16ff2, 0x16ff3), (0x16ff4, 0x16ff6), (0x187f8, 0x187ff), (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80, 0x18df2),
    (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168), (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24),
    (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de), (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5),
    (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4), (0x1e6fe, 0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead),
    (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
]
NEWER_CLASS = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER) + "]"


def known_classes(pattern: str) -> str:
    """The pattern for the few texts that hold newer letters and numbers, which are neither."""
    both = NEWER_CLASS
    new = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{both})")
    return new.replace(r"[\p{L}]", rf"(?:(?!{both})\p{{L}})").replace(r"[\p{N}]", rf"(?:(?!{both})\p{{N}})")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


def unsafe(left: np.ndarray, right: np.ndarray, made: np.ndarray, size: int) -> np.ndarray:
    """Merges whose symbol takes part in an earlier merge: one such place may change the others, so they go one at a time."""
    used, rank = np.full(size, NEVER), np.arange(len(made))
    np.minimum.at(used, left, rank)
    np.minimum.at(used, right, rank)
    return used[made] < rank


class Vocabulary:
    """The arrays of a vocabulary file; some MB, sent to the workers once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, mark = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.size = max([*ids.values(), *self.special.values()]) + 1
        names = [""] * self.size
        for name, i in [*ids.items(), *self.special.items()]:
            names[i] = name
        self.tokens = pa.array(names)
        self.inside = np.array([ids[c] for c in byte_characters()], np.int64)
        self.last = np.array([ids[c + mark] for c in byte_characters()], np.int64)
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        left, right = (np.array([ids[p[side]] for p in pairs], np.int64) for side in (0, 1))
        made = np.array([ids[p[0] + p[1]] for p in pairs], np.int64)
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys, self.rank, self.made = (left * self.size + right)[order], order.astype(np.int64), made
        self.single = unsafe(left, right, made, self.size)
        self._table: dict[int, int] | None = None

    def table(self) -> dict[int, int]:
        """The rank of each pair key, for single look-ups; made where it is first used."""
        if self._table is None:
            self._table = dict(zip(self.keys.tolist(), self.rank.tolist(), strict=True))
        return self._table

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER if there is none."""
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank[at], NEVER)


def merge_one(v: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """The merges of one word by a heap of (rank, place) over linked symbols."""
    s, n = symbols.tolist(), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = v.ranks(symbols[:-1], symbols[1:])
    current, table = rank.tolist() + [NEVER], v.table()
    heap = [(r, i) for i, r in enumerate(current) if r != NEVER]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if current[i] != r:
            continue
        j = after[i]
        s[i], s[j], current[j] = int(v.made[r]), -1, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if a >= 0:
                new = table.get(s[a] * v.size + s[b], NEVER) if b < n else NEVER
                current[a] = new
                if new != NEVER:
                    heapq.heappush(heap, (new, a))
    return np.array([x for x in s if x >= 0], np.int64)


def merge_all(v: Vocabulary, symbols: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of many non-empty words in one flat array, and their offsets."""
    words = len(offs) - 1
    done_ids: list[np.ndarray] = []
    done_word: list[np.ndarray] = []
    word = np.repeat(np.arange(words), np.diff(offs))
    ranks = np.full(len(symbols), NEVER)
    inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.zeros(0, np.int64)
    ranks[inner] = v.ranks(symbols[inner], symbols[inner + 1])
    while len(symbols):
        heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        lowest = np.minimum.reduceat(ranks, heads)
        each = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(symbols))))
        over = lowest == NEVER
        if over.any():
            gone = over[each]
            done_ids.append(symbols[gone])
            done_word.append(word[gone])
            stay = ~gone
            symbols, word, ranks = symbols[stay], word[stay], ranks[stay]
            each, lowest = (np.cumsum(~over) - 1)[each[stay]], lowest[~over]
            if not len(symbols):
                break
        at = np.flatnonzero(ranks == lowest[each])
        # Of places in a row every second one, from the left; of single pairs only the first place of a word.
        run = np.concatenate(([True], at[1:] != at[:-1] + 1))
        first = np.flatnonzero(run)
        nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        own = each[at]
        leading = np.concatenate(([True], own[1:] != own[:-1]))
        at = at[(nth % 2 == 0) & (leading | ~v.single[lowest[own]])]
        symbols[at] = v.made[ranks[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
        at = place[at]
        near = np.unique(np.concatenate((at, at[at > 0] - 1)))
        inside = near[near + 1 < len(symbols)]
        ranks[near] = NEVER
        inside = inside[word[inside] == word[inside + 1]]
        ranks[inside] = v.ranks(symbols[inside], symbols[inside + 1])
    if not done_ids:
        return np.zeros(0, np.int64), np.zeros(words + 1, np.int64)
    word, flat = np.concatenate(done_word), np.concatenate(done_ids)
    order = np.argsort(word, kind="stable")
    return flat[order], np.searchsorted(word[order], np.arange(words + 1))


LETTER, NUMBER, OTHER = 1, 2, 3


def _class(c: int) -> int:
    kind = unicodedata.category(chr(c))[0]
    return 0 if chr(c).isspace() and not 0x1C <= c <= 0x1F else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER


#: Class and lower case of ASCII bytes and, by lead and second byte, of characters below U+0250.
_KIND1 = np.array([_class(c) if c < 128 else 0 for c in range(256)], np.uint8)
_TWO = [c if c >= 0x80 else 0xD7 for c in range(0x250)]
_KIND2 = np.array([_class(c) for c in _TWO], np.uint8)
_LOWER2 = np.array([list((chr(c).lower() if len(chr(c).lower().encode()) == 2 else chr(c)).encode()) for c in _TWO], np.uint8)
#: Bytes from here on, and a few characters whose lower case is longer, are left to the pattern.
_FIRST_OTHER, _LONGER = 0xC9, (0x130, 0x23A, 0x23E)


def plain_rows(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows of characters below U+0240 alone, without the start of a special token."""
    odd = data >= _FIRST_OTHER
    lead = np.flatnonzero((data >= 0xC0) & ~odd)
    odd[lead[np.isin((data[lead].astype(np.int64) - 0xC0) * 64 + data[lead + 1] - 0x80, _LONGER)]] = True
    if len(data) > 1:
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    total = np.concatenate(([0], np.cumsum(odd)))
    return total[offs[1:]] == total[offs[:-1]]


def plain_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of plain rows, and the starts and ends of their words, as the pattern finds them."""
    low, kind = tk.LOWER[data], _KIND1[data]
    lead = np.flatnonzero(data >= 0xC0)
    code = (data[lead].astype(np.int64) - 0xC0) * 64 + data[lead + 1] - 0x80
    low[lead], low[lead + 1] = _LOWER2[code, 0], _LOWER2[code, 1]
    kind[lead] = kind[lead + 1] = _KIND2[code]
    start = (kind != 0) & ((data & 0xC0) != 0x80)
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    heads = offs[:-1][offs[:-1] < offs[1:]]
    start[heads] = kind[heads] != 0
    stop = start | (kind == 0)
    stop[heads] = True
    starts, stops = np.flatnonzero(start), np.append(np.flatnonzero(stop), len(data))
    ends = stops[np.searchsorted(stops, starts, side="right")]
    # An apostrophe by itself takes s, t, m, d, re, ve or ll from the letters after it.
    head = np.zeros(len(data) + 1, bool)
    head[heads] = True
    lone = np.flatnonzero((low[starts] == 0x27) & (ends - starts == 1))
    lone = lone[(lone + 1 < len(starts))]
    lone = lone[(starts[lone + 1] == ends[lone]) & ~head[ends[lone]]]
    if len(lone):
        at, room = starts[lone + 1], ends[lone + 1] - starts[lone + 1]
        one = low[at].astype(np.int64)
        two = np.where(room > 1, one * 256 + low[np.minimum(at + 1, len(low) - 1)], 0)
        take = np.where(np.isin(one, list(b"stmd")), 1, np.where(np.isin(two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]), 2, 0))
        ends[lone] += take
        starts[lone + 1] += take
        full = starts < ends
        starts, ends = starts[full], ends[full]
    return low, starts, ends


def distinct(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and each word's number among them; equal hashes are verified byte by byte."""
    _, place, number = np.unique(tk.hash_spans(low, starts, ends), return_index=True, return_inverse=True)
    other, size = place[number], ends - starts
    wrong = size != ends[other] - starts[other]
    for at, to in tk.chunks(np.concatenate(([0], np.cumsum(size)))):
        same = np.flatnonzero(~wrong[at:to]) + at
        n = size[same]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differs = low[np.repeat(starts[same], n) + step] != low[np.repeat(starts[other[same]], n) + step]
        wrong[np.repeat(same, n)[differs]] = True
    odd = np.flatnonzero(wrong)  # words that share another's hash stand for themselves
    number[odd] = len(place) + np.arange(len(odd))
    return np.concatenate((place, odd)), number


class Encoder:
    """Ids of texts; the ids of words are kept for later batches until they take too much memory."""

    def __init__(self, v: Vocabulary):
        self.v, self.words, self.later = v, regex.compile(v.split), later_lower()
        self.newer, self.exact = regex.compile(NEWER_CLASS), regex.compile(known_classes(v.split))
        self.marks = regex.compile("(" + "|".join(regex.escape(x) for x in v.special) + ")") if v.special else None
        self.clear()

    def clear(self) -> None:
        #: Words are bytes, special tokens strings.
        self.known: dict[object, int] = {name: i for i, name in enumerate(self.v.special)}
        self.flat = np.array(list(self.v.special.values()), np.int64)
        self.offs = np.arange(len(self.v.special) + 1)
        self.held = 0

    def normal(self, text: str) -> str:
        """Composed, and each character lower-cased by itself; white space only parts words."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").translate(self.later).lower()

    def find(self, text: str) -> list[bytes]:
        low = self.normal(text)
        return [w.encode() for w in (self.exact if self.newer.search(low) else self.words).findall(low)]

    def split(self, text: str) -> list:
        """A text's words by the pattern."""
        if self.marks is None or "<|" not in text:
            return self.find(text)
        out: list = []
        for i, part in enumerate(self.marks.split(text)):
            out += [part] if i % 2 else self.find(part)
        return out

    def learn(self, words: list[bytes]) -> None:
        """Encode words that aren't known."""
        data, size = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        offs = np.concatenate(([0], np.cumsum(size)))
        symbols = self.v.inside[data]
        symbols[offs[1:] - 1] = self.v.last[data[offs[1:] - 1]]
        long = size >= LONG
        flat, at = merge_all(self.v, symbols[~np.repeat(long, size)], np.concatenate(([0], np.cumsum(size[~long]))))
        if long.any():
            short = iter(np.split(flat, at[1:-1]) if len(at) > 1 else [])
            parts = [merge_one(self.v, symbols[offs[i] : offs[i + 1]]) if long[i] else next(short) for i in range(len(words))]
            flat, at = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        for i, w in enumerate(words, len(self.offs) - 1):
            self.known[w] = i
        self.offs = np.concatenate((self.offs, at[1:] + self.offs[-1]))
        self.flat = np.concatenate((self.flat, flat))
        self.held += len(data) + 100 * len(words)

    def numbers(self, words: list) -> np.ndarray:
        """The numbers of words, unknown ones encoded first."""
        if new := list({w: None for w in words if w not in self.known}):
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts of an Arrow column and the offset of each text's first."""
        if self.held > KEPT:
            self.clear()
        data, offs = tk.utf8(texts)
        plain = plain_rows(data, offs)
        own = data[np.repeat(plain, np.diff(offs))]
        bounds = np.concatenate(([0], np.cumsum(np.diff(offs)[plain])))
        low, starts, ends = plain_words(own, bounds)
        place, number = distinct(low, starts, ends)
        raw = low.tobytes()
        number = self.numbers([raw[s:e] for s, e in zip(starts[place].tolist(), ends[place].tolist(), strict=True)])[number]
        row = np.flatnonzero(plain)[np.searchsorted(bounds, starts, side="right") - 1]
        if not plain.all():
            rest = [(int(i), self.split(texts[int(i)].as_py() or "")) for i in np.flatnonzero(~plain)]
            number = np.concatenate((number, self.numbers([w for _, words in rest for w in words])))
            row = np.concatenate((row, np.repeat([i for i, _ in rest], [len(words) for _, words in rest])))
            order = np.argsort(row, kind="stable")
            number, row = number[order], row[order]
        count = self.offs[number + 1] - self.offs[number]
        ends = np.concatenate(([0], np.cumsum(count)))
        at = np.arange(ends[-1]) + np.repeat(self.offs[number] - ends[:-1], count)
        return self.flat[at], ends[np.searchsorted(row, np.arange(len(offs)))]


def _encode(shared):
    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            _, offs = tk.utf8(batch.column(1))
            for at, to in tk.chunks(offs, 4 << 20):
                ids, bounds = encoder.encode(batch.column(1).slice(at, to - at))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists], names=["id", "ids"])
        tk.release()

    return run


def _decode(shared):
    def run(batches):
        names = shared.value.tokens
        for batch in batches:
            ids = batch.column(1)
            _, offs = ids.flatten(), np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())))
            for at, to in tk.chunks(offs, 1 << 20):
                part = ids.slice(at, to - at)
                own = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy()))).astype(np.int64)
                lists = pa.LargeListArray.from_arrays(pa.array(own), names.take(part.flatten()))
                text = pc.binary_join(lists, " ").cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), text, part], names=["id", "decoded", "ids"])
        tk.release()

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the ids of each whole text.  The driver reads the vocabulary file and sends its arrays (under 4 MB)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encode(shared), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, decoded, ids): the names of the ids with blanks between, as the library decodes a vocabulary without a decoder."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_decode(shared), f"id {kind}, decoded string, ids array<int>").withColumnRenamed("id", id_col)


def readable(decoded, mark: str = "</w>"):
    """The text that a decoded string stands for: words with a blank between, bytes instead of their characters (a Column)."""
    letters = byte_characters()
    joined = F.regexp_replace(F.replace(F.replace(decoded, F.lit(" "), F.lit("")), F.lit(mark), F.lit("\u0000")), "\u0000$", "")
    bytes_ = F.translate(joined, "".join(letters) + "\u0000", "".join(map(chr, range(256))) + " ")
    return F.decode(F.encode(bytes_, "ISO-8859-1"), "UTF-8")


def query(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to, as digests."""
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
