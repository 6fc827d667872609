"""SentencePiece encoding and decoding with n-best segmentation.

A text is segmented over the lattice of a piece vocabulary: a segmentation's score is the sum
of its pieces' scores.  The best ones are found by forward Viterbi, whose scores then are the
exact heuristics of a backward A* search: a partial path from the end is worth what it has
gathered plus the best score of the rest, so the search pops complete paths in order.

No piece goes on after a word's end, so the lattice of a text is a chain of the lattices of its
words (spaces, then other bytes; this is tested when a vocabulary is loaded).  Therefore

* the forward and backward scores of all distinct words of a batch are computed at once, by
  position and piece length, in numpy;
* a word's second-best score is the best path through any edge off its best path;
* a text's n best segmentations change its best one in the n - 1 words with the smallest loss
  only; the search runs for these, and their losses are merged.  Each segmentation is given as
  its changes to the best one: places and the new ids there.

Characters that no piece covers become byte pieces with the score of an unknown character (the
lowest score less 10).  A space stands before the text, as the vocabulary expects; decoding
takes it off again.  Decoding returns exactly the text, also for texts with the vocabulary's
own space mark.  Null texts are encoded like empty ones: no pieces.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.shared import bound_batches

MODEL, BEST = "/opt/tokenizers/piece_bpe_32k.model", 4
#: Bytes of distinct words in one computation, the length from which a word is done alone, and
#: the words whose n best segmentations are kept.
PART, LONG, KEPT = 1 << 16, 192, 50_000
SLOTS, SUNK = 20, -1e8


class Vocabulary:
    """Pieces as bytes (the space mark as a space), their scores, and hash tables by length."""

    def __init__(self, pieces: list[bytes | None], scores: list[float], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, np.array(byte_ids, dtype=np.int32)
        self.id_of = {p: i for i, p in reversed(list(enumerate(pieces))) if p}
        self.score = np.array(scores, dtype=np.float64)
        # Some pieces are sunk to a score that no segmentation should use; they set no scale.
        self.unknown = float(min(scores[i] for i in self.id_of.values() if scores[i] > SUNK)) - 10.0
        self.longest = max(map(len, self.id_of))
        if any(b" " in p.lstrip(b" ") for p in self.id_of):
            raise ValueError("a piece goes on after a word's end")
        # What each id decodes to.
        self.bytes_of = [p or b"" for p in pieces]
        for value, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([value])
        self.tables = {}
        for length in range(1, self.longest + 1):
            own = [i for p, i in self.id_of.items() if len(p) == length]
            if own:
                data = np.frombuffer(b"".join(pieces[i] for i in own), dtype=np.uint8)
                at = np.arange(len(own)) * length
                h = tk.span_hash(tk.prefix_hash(data), at, at + length)
                order = np.argsort(h)
                slots = np.zeros(1 << SLOTS, dtype=bool)
                slots[(h >> np.uint64(64 - SLOTS)).astype(np.int64)] = True
                self.tables[length] = (h[order], np.array(own)[order], slots)

    @classmethod
    def load(cls, path: str = MODEL) -> "Vocabulary":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        special = [m.is_byte(i) or m.is_control(i) or m.is_unknown(i) for i in range(n)]
        pieces = [None if special[i] else m.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        scores = [m.get_score(i) for i in range(n)]
        return cls(pieces, scores, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def edges(self, data: np.ndarray, left: np.ndarray):
        """(length, starts, ids, scores) of all pieces in some words; left: bytes to each word's end.

        Characters that are no piece get the unknown score and id -1.
        """
        prefix = tk.prefix_hash(data)
        n = len(data)
        size = np.ones(n, np.int64)
        for least, length in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
            size[data >= least] = length
        size = np.minimum(size, left)
        lead = (data & 0xC0) != 0x80
        covered = ~lead
        out = []
        for length, (h, ids, slots) in self.tables.items():
            at = np.flatnonzero(left >= length)
            if not len(at):
                break
            own = tk.span_hash(prefix, at, at + length)
            maybe = slots[(own >> np.uint64(64 - SLOTS)).astype(np.int64)]
            at, own = at[maybe], own[maybe]
            row = np.minimum(np.searchsorted(h, own), len(h) - 1)
            hit = h[row] == own
            at, row = at[hit], row[hit]
            whole = at[size[at] == length]
            covered[whole] = True
            out.append((length, at, ids[row], self.score[ids[row]]))
        bare = np.flatnonzero(~covered)
        for length in range(1, 5):
            at = bare[size[bare] == length]
            if len(at):
                out.append((length, at, np.full(len(at), -1), np.full(len(at), self.unknown)))
        return out


def lattice(v: Vocabulary, word: bytes) -> list[list[tuple[int, int, float]]]:
    """For each end, the edges (start, id, score) that reach it."""
    data = np.frombuffer(word, dtype=np.uint8)
    into: list[list[tuple[int, int, float]]] = [[] for _ in range(len(word) + 1)]
    for length, at, ids, scores in v.edges(data, np.arange(len(word), 0, -1)):
        for a, i, s in zip(at.tolist(), ids.tolist(), scores.tolist(), strict=True):
            into[a + length].append((a, i, s))
    for x in into:
        x.sort()
    return into


def n_best(v: Vocabulary, word: bytes, n: int) -> list[tuple[float, list[tuple[int, int, int]]]]:
    """The n best segmentations of a word: score and edges (start, end, id); ties in lattice order."""
    into = lattice(v, word)
    alpha = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start, _, score in into[end]:
            if alpha[start] + score > alpha[end]:
                alpha[end] = alpha[start] + score
    heap, tick, out = [(-alpha[-1], 0, len(word), 0.0, None)], 0, []
    while heap and len(out) < n:
        _, _, at, gathered, path = heapq.heappop(heap)
        if at == 0:
            edges = []
            while path is not None:
                edge, path = path
                edges.append(edge)
            out.append((gathered, edges))
            continue
        for start, piece, score in into[at]:
            if alpha[start] > -np.inf:
                tick += 1
                heapq.heappush(heap, (-(gathered + score + alpha[start]), tick, start, gathered + score, ((start, at, piece), path)))
    return out


def best_of(v: Vocabulary, data: np.ndarray, first: np.ndarray):
    """For each word: best score, loss of the second best, and its best pieces (ids flat, with offsets).

    ``first`` holds the words' n + 1 offsets in ``data``.
    """
    n, total = len(first) - 1, len(data)
    length = np.diff(first)
    left = np.repeat(first[1:], length) - np.arange(total)
    width = int(length.max())
    edges = v.edges(data, left)
    spans = sorted({e[0] for e in edges})
    score = {k: np.full(total, -np.inf) for k in spans}
    ids = {k: np.full(total, -1, np.int64) for k in spans}
    for k, at, i, s in edges:
        score[k][at], ids[k][at] = s, i
    # One row for each word, padded; words come in groups of about equal length.
    start = first[:-1]
    alpha = np.full((width + 1, n), -np.inf)
    alpha[0] = 0
    back = np.zeros((width + 1, n), dtype=np.int16)
    for end in range(1, width + 1):
        for k in spans:
            if k > end:
                break
            place = np.minimum(start + end - k, total - 1)
            new = alpha[end - k] + np.where(length >= end, score[k][place], -np.inf)
            better = new > alpha[end]
            alpha[end] = np.where(better, new, alpha[end])
            back[end] = np.where(better, k, back[end])
    every = np.arange(n)
    best = alpha[length, every]
    on_path = np.zeros(total + 1, dtype=np.int16)  # at a piece's start: its length
    at = length.copy()
    while True:
        going = np.flatnonzero(at > 0)
        if not len(going):
            break
        step = back[at[going], going]
        at[going] -= step
        on_path[start[going] + at[going]] = step
    beta = np.full((width + 1, n), -np.inf)
    beta[length, every] = 0
    second = np.full(n, -np.inf)
    for begin in range(width - 1, -1, -1):
        for k in spans:
            end = begin + k
            if end > width:
                break
            inside = length >= end
            place = np.minimum(start + begin, total - 1)
            through = np.where(inside, score[k][place], -np.inf) + beta[end]
            beta[begin] = np.maximum(beta[begin], through)
            off = np.where(on_path[place] == k, -np.inf, through + alpha[begin])
            second = np.maximum(second, off)
    heads = np.flatnonzero(on_path)
    used = on_path[heads].astype(np.int64)
    piece = np.zeros(len(heads), np.int64)
    for k in spans:
        mine = used == k
        piece[mine] = ids[k][heads[mine]]
    bare = piece < 0
    repeat = np.where(bare, used, 1)
    flat = np.repeat(piece, repeat)
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    unknown = np.repeat(bare, repeat)
    flat[unknown] = v.byte_ids[data[(np.repeat(heads, repeat) + inner)[unknown]]]
    owner = np.repeat(np.repeat(every, length)[heads], repeat)
    return best, best - second, flat.astype(np.int32), np.searchsorted(owner, np.arange(n + 1))


def _ids(v: Vocabulary, word: bytes, edges: list[tuple[int, int, int]]) -> list[int]:
    flat = []
    for start, end, i in edges:
        flat += [i] if i >= 0 else v.byte_ids[np.frombuffer(word[start:end], np.uint8)].tolist()
    return flat


def _long(v: Vocabulary, word: bytes):
    """``best_of`` for one long word, by the scalar search."""
    found = n_best(v, word, 2)
    return found[0][0], found[0][0] - (found[1][0] if len(found) > 1 else -np.inf), _ids(v, word, found[0][1])


class Encoder:
    """Encodes batches of texts; keeps the searched words between batches."""

    def __init__(self, v: Vocabulary, best: int = BEST):
        self.v, self.best, self.kept = v, best, {}

    def losses(self, word: bytes, best: np.ndarray) -> list[tuple[float, bytes]]:
        """Loss and ids of the word's 2nd to n-th best segmentations, by the A* search; ``best`` are the best one's ids."""
        if word not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            found = n_best(self.v, word, self.best)
            made = [(found[0][0] - score, np.array(_ids(self.v, word, edges), np.int32).tobytes()) for score, edges in found]
            # With ties the search may find the best one later, or not among so many.
            at = next((i for i, (_, x) in enumerate(made) if x == best.tobytes()), len(made) - 1)
            self.kept[word] = made[:at] + made[at + 1 :]
        return self.kept[word]

    def merge(self, words: list[tuple[bytes, np.ndarray]]) -> list[tuple[float, tuple[tuple[int, bytes], ...]]]:
        """The n smallest sums of losses, taking one segmentation of each word, with the changed words' places in the list and ids.

        The first is 0 and changes nothing.
        """
        sums = [(0.0, ())]
        for i, (word, best) in enumerate(words):
            own = [(loss, ((i, x),)) for loss, x in self.losses(word, best)]
            sums = heapq.nsmallest(self.best, [(a + b, c + d) for a, c in sums for b, d in ((0.0, ()), *own)], key=lambda x: x[0])
        return sums

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, float, list[float]]]:
        """For each text: ids, the best score, and the scores of the n best segmentations."""
        return [r[:3] for r in self.segmentations(data, offs)]

    def segmentations(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, float, list[float], list[list[tuple[int, int, bytes]]]]]:
        """What ``encode`` returns, and for each of the n best segmentations its changes to the best ids.

        A change is (at, n, ids): ids (int32) stand for the n best ones from ``at`` on; in order of ``at``.
        """
        n = len(offs) - 1
        # A space before each text that isn't empty.
        size = np.diff(offs)
        lead = (size > 0).astype(np.int64)
        new_offs = np.concatenate(([0], np.cumsum(size + lead)))
        text = np.full(new_offs[-1], 0x20, dtype=np.uint8)
        row = np.repeat(np.arange(n), size)
        text[np.arange(len(data)) - offs[row] + new_offs[row] + lead[row]] = data
        if not len(text):
            return [(np.zeros(0, np.int32), 0.0, [0.0], [[]]) for _ in range(n)]
        space = text == 0x20
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[new_offs[:-1][size > 0]] = True
        starts = np.flatnonzero(head)
        ends = np.concatenate((starts[1:], [len(text)]))
        hashes = tk.span_hash(tk.prefix_hash(text), starts, ends)
        _, at, of = np.unique(hashes, return_index=True, return_inverse=True)
        length = (ends - starts)[at]
        order = np.argsort(length, kind="stable")
        best, loss = np.zeros(len(at)), np.zeros(len(at))
        ids: list = [None] * len(at)
        long_from = int(np.searchsorted(length[order], LONG, side="right"))
        i = 0
        while i < long_from:  # groups of like length and about PART bytes
            j = min(long_from, i + max(1, PART // int(length[order[i]])))
            group = order[i:j]
            lens = length[group]
            first = np.concatenate(([0], np.cumsum(lens)))
            place = np.repeat(starts[at[group]], lens) + np.arange(first[-1]) - np.repeat(first[:-1], lens)
            b, d, flat, cut = best_of(self.v, text[place], first)
            best[group], loss[group] = b, d
            for g, lo, hi in zip(group.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                ids[g] = flat[lo:hi]
            i = j
        for g in order[long_from:].tolist():
            best[g], loss[g], flat = _long(self.v, text[starts[at[g]] : ends[at[g]]].tobytes())
            ids[g] = np.array(flat, dtype=np.int32)
        out, word_first = [], np.searchsorted(starts, new_offs)
        count = np.array([len(x) for x in ids], dtype=np.int64)
        pool, pool_first = np.concatenate(ids), np.concatenate(([0], np.cumsum(count)))
        for i in range(n):
            lo, hi = word_first[i], word_first[i + 1]
            if lo == hi:
                out.append((np.zeros(0, np.int32), 0.0, [0.0], [[]]))
                continue
            mine = of[lo:hi]
            c = count[mine]
            place = np.cumsum(c) - c
            flat = pool[np.repeat(pool_first[mine] - place, c) + np.arange(c.sum())]
            need = min(self.best - 1, len(mine))
            near = np.sort(np.argpartition(loss[mine], need - 1)[:need]) if need else []
            near = [(w, mine[w]) for w in near if np.isfinite(loss[mine[w]])]
            found = self.merge([(text[starts[at[g]] : ends[at[g]]].tobytes(), ids[g]) for _, g in near])
            total = float(best[mine].sum())
            where = [(int(place[w]), int(c[w])) for w, _ in near]
            out.append((flat, total, [total - x for x, _ in found], [[(*where[k], x) for k, x in changes] for _, changes in found]))
        return out


def decode(v: Vocabulary, ids) -> bytes:
    """The text's bytes, without the space that encoding puts before it."""
    made = b"".join(map(v.bytes_of.__getitem__, ids))
    return made[1:] if made[:1] == b" " else made


CHANGES = "array<array<struct<at: int, n: int, ids: array<int>>>>"


def _lists(counts: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)


def _changes(rows: list[list[list[tuple[int, int, bytes]]]]) -> pa.ListArray:
    """The changes of some texts' segmentations as an Arrow array of the type CHANGES."""
    ranks = [x for r in rows for x in r]
    flat = [x for r in ranks for x in r]
    ids = _lists([len(x[2]) // 4 for x in flat], pa.array(np.frombuffer(b"".join(x[2] for x in flat), np.int32)))
    parts = [pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), ids]
    return _lists([len(r) for r in rows], _lists([len(r) for r in ranks], pa.StructArray.from_arrays(parts, ["at", "n", "ids"])))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, best: int = BEST) -> DataFrame:
    """(id, n_pieces, score, nbest_scores, ids, round_trip, nbest_changes) for every row; the model is read on the driver.

    nbest_changes goes with nbest_scores; ``segmentations`` makes rows of ids of it.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))  # of the vocabulary's fixed size

    def run(batches):
        v = shared.value
        encoder = Encoder(v, best)
        for batch in batches:
            data, offs = tk.utf8(batch.column(1))
            for at, to in tk.chunks(offs, 2_000_000):
                rows = encoder.segmentations(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
                same = [decode(v, ids.tolist()) == data[offs[i] : offs[i + 1]].tobytes() for i, (ids, *_) in zip(range(at, to), rows, strict=True)]
                count = np.array([len(r[0]) for r in rows], dtype=np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(np.concatenate([r[0] for r in rows])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(count), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.float64())), flat, pa.array(same), _changes([r[3] for r in rows])],
                    names=["id", "n_pieces", "score", "nbest_scores", "ids", "round_trip", "nbest_changes"],
                )
        del encoder
        tk.release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id long, n_pieces long, score double, nbest_scores array<double>, ids array<int>, round_trip boolean, nbest_changes {CHANGES}")
    return out.withColumnRenamed("id", id_col)


def segmentations(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, rank, score, ids) of each of the n best segmentations, from rows that ``encode`` made; rank 0 is the best."""
    rows = encoded.select(id_col, "ids", F.posexplode(F.arrays_zip("nbest_scores", "nbest_changes")).alias("rank", "r"))
    cut = lambda acc, x: F.concat(F.slice(acc, F.lit(1), x["at"]), x["ids"], F.slice(acc, x["at"] + x["n"] + 1, F.size(acc)))
    made = F.aggregate(F.reverse("r.nbest_changes"), F.col("ids"), cut)  # from the last place on, so that earlier ones stay right
    return rows.select(id_col, "rank", F.col("r.nbest_scores").alias("score"), made.alias("ids"))


def decode_rows(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(id, text) from rows of piece ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches):
        for batch in batches:
            texts = [decode(shared.value, x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col)).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """The four best segmentations of all documents: scores, the best one's pieces, and the others' changes to it."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
