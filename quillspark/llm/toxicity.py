"""Toxicity scores from a bidirectional gated recurrent network, trained in numpy.

A word's input is its own vector (a learned vocabulary of at most ``VOCABULARY`` words, chosen
by how far their log odds in the training sample are from 0) beside the mean of the vectors of
its hashed character trigrams.  The text is cut into windows of ``WINDOW`` words, one every
``STRIDE`` words, so every word but the first few stands in two of them.  Both directions of
the network run over a window, attention pools their states, and a logistic unit scores it.  A
text's score is its highest window's, calibrated on the training sample.

The label stands for a whole text, so training is by instance selection: all windows of clean
texts are negatives, and of a toxic text the window that scores highest so far is the positive.

Learned from at most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` clean labelled rows, those with
the lowest id hashes, and never from held-out ones; of rows that share an id from one, and from
no text of more than ``ROW_BYTES``, so that the driver holds a bounded sample.  Labels, language, source and id are no
inputs.  Null and wordless texts score 0, and so does everything where nothing was learned.
Whole texts of any length are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.shared import bound_batches

WINDOW, STRIDE, HIDDEN = 24, 12, 8
WORD_DIM, CHAR_DIM, CHAR_ROWS, VOCABULARY = 8, 4, 4096, 4096
TOXIC_ROWS, CLEAN_ROWS, ROW_BYTES = 800, 1600, 1 << 18
EPOCHS, STEPS, BATCH, RATE, THRESHOLD = 2, 60, 256, 0.01, 0.7
#: Words: letters, digits and all bytes beyond ASCII; the rest separates.
BREAK = np.ones(256, dtype=bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    BREAK[_lo : _hi + 1] = False


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Words:
    """The words of some texts: the distinct ones with their trigrams, and their places."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        low = tk.LOWER[data]
        starts, ends = tk.spans(~BREAK[low], offs)
        self.first = np.searchsorted(starts, offs)
        hashes = np.zeros(len(starts), tk.U64)
        for i, j in tk.chunks(offs):
            own = slice(self.first[i], self.first[j])
            hashes[own] = tk.span_hash(tk.prefix_hash(low[offs[i] : offs[j]]), starts[own] - offs[i], ends[own] - offs[i])
        self.hash, at, of = np.unique(hashes, return_index=True, return_inverse=True)
        self.of = of.astype(np.int32)
        # Trigrams with a mark at both ends, as rows of the character table.
        begin, length = starts[at], ends[at] - starts[at]
        self.tri_first = np.concatenate(([0], np.cumsum(length)))
        inner = np.arange(self.tri_first[-1]) - np.repeat(self.tri_first[:-1], length)
        place = np.repeat(begin, length) + inner
        wide = np.concatenate((low, [0])).astype(np.uint32)
        before = np.where(inner == 0, np.uint32(1), wide[place - 1])
        after = np.where(inner == np.repeat(length, length) - 1, np.uint32(2), wide[place + 1])
        code = (before << np.uint32(16)) | (wide[place] << np.uint32(8)) | after
        self.tri = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64) % CHAR_ROWS

    def only(self, ids: np.ndarray) -> tuple["Words", np.ndarray]:
        """The distinct words of some windows, and the windows in their numbers."""
        some = np.unique(ids[ids >= 0])
        out = Words.__new__(Words)
        out.hash, length = self.hash[some], np.diff(self.tri_first)[some]
        out.tri_first = np.concatenate(([0], np.cumsum(length)))
        out.tri = self.tri[np.arange(out.tri_first[-1]) - np.repeat(out.tri_first[:-1], length) + np.repeat(self.tri_first[some], length)]
        return out, np.where(ids >= 0, np.searchsorted(some, ids), -1)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct-word numbers of each window (-1 beyond the text's end) and the window's text."""
        count = np.diff(self.first)
        pieces = np.where(count == 0, 0, np.maximum(1, -(-(count - (WINDOW - STRIDE)) // STRIDE)))
        text = np.repeat(np.arange(len(count)), pieces)
        inner = np.arange(len(text)) - np.repeat(np.concatenate(([0], np.cumsum(pieces)[:-1])), pieces)
        place = (self.first[text] + inner * STRIDE).astype(np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)[None, :]
        inside = place < self.first[text + 1][:, None]
        return np.where(inside, self.of[np.minimum(place, max(0, len(self.of) - 1))] if len(self.of) else -1, -1), text


class Net:
    """Two gated recurrent directions, attention and a logistic unit; parameters in a dict."""

    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary  # sorted word hashes; row 0 of the table is for all other words
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        word = 0.1 * rng.standard_normal((len(vocabulary) + 1, WORD_DIM)).astype(np.float32)
        word[0] = 0
        word[1:, 0] = odds
        self.p = {"word": word, "char": 0.05 * rng.standard_normal((CHAR_ROWS, CHAR_DIM)).astype(np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": scale(d, 3 * h), f"U{side}": scale(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": scale(2 * h, h), "a": np.zeros(h, np.float32), "v": scale(h), "o": scale(2 * h), "b": np.zeros(1, np.float32)}
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The input vector of each distinct word and its row in the word table."""
        row = np.searchsorted(self.vocabulary, words.hash)
        known = (row < len(self.vocabulary)) & (self.vocabulary[np.minimum(row, len(self.vocabulary) - 1)] == words.hash) if len(self.vocabulary) else np.zeros(len(row), bool)
        row = np.where(known, row + 1, 0)
        if not len(row):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32), row
        mean = np.add.reduceat(self.p["char"][words.tri], words.tri_first[:-1], axis=0) / np.diff(words.tri_first)[:, None]
        return np.concatenate((self.p["word"][row], mean), axis=1).astype(np.float32), row

    def states(self, gates: np.ndarray, ids: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """The states of one direction, [step, window, unit]; gates: the input part for each distinct word."""
        h, u = np.zeros((len(ids), HIDDEN), np.float32), self.p[f"U{side}"]
        out = np.zeros((WINDOW, len(ids), HIDDEN), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            x, m = gates[ids[:, t]], h @ u
            zr = sigmoid(x[:, : 2 * HIDDEN] + m[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * m[:, 2 * HIDDEN :])
            z = np.where((ids[:, t] >= 0)[:, None], z, np.float32(1))  # beyond the end the state stays
            new = n + z * (h - n)
            if keep is not None:
                keep.append((t, h, z, r, n, m))
            out[t] = h = new
        return out

    def forward(self, x: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window."""
        parts = []
        for side in "fb":
            gates = np.concatenate((x @ self.p[f"W{side}"] + self.p[f"c{side}"], np.zeros((1, 3 * HIDDEN), np.float32)))
            steps: list | None = [] if keep is not None else None
            parts.append(self.states(gates, ids, side, steps))
            if keep is not None:
                keep[side] = steps
        h = np.concatenate(parts, axis=2)
        k = np.tanh(h @ self.p["A"] + self.p["a"])
        e = np.where((ids >= 0).T, k @ self.p["v"], np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, h)
        if keep is not None:
            keep |= {"h": h, "k": k, "w": w, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["b"][0]

    def step(self, x: np.ndarray, row: np.ndarray, words: Words, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the weighted logistic loss over some windows."""
        keep: dict = {}
        d = ((sigmoid(self.forward(x, ids, keep)) - y) * weight / len(y)).astype(np.float32)
        p, h, k, w, g = self.p, keep["h"], keep["k"], keep["w"], {}
        g["o"], g["b"] = keep["pooled"].T @ d, np.array([d.sum()])
        dp = d[:, None] * p["o"][None, :]
        dh = w[:, :, None] * dp[None]
        dw = np.einsum("nh,tnh->tn", dp, h)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tn,tnk->k", de, k)
        dk = de[:, :, None] * p["v"] * (1 - k * k)
        g["A"], g["a"] = np.einsum("tnh,tnk->hk", h, dk), dk.sum(axis=(0, 1))
        dh = dh + dk @ p["A"].T
        dx = np.zeros_like(x)
        for s, side in enumerate("fb"):
            u, back = p[f"U{side}"], np.zeros((len(ids), HIDDEN), np.float32)
            gates, du = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32), np.zeros_like(u)
            for t, before, z, r, n, m in reversed(keep[side]):
                back = back + dh[t][:, s * HIDDEN : (s + 1) * HIDDEN]
                dn, dz = back * (1 - z) * (1 - n * n), back * (before - n) * z * (1 - z)
                dr = dn * m[:, 2 * HIDDEN :] * r * (1 - r)
                dm = np.concatenate((dz, dr, dn * r), axis=1)
                np.add.at(gates, ids[:, t], np.concatenate((dz, dr, dn), axis=1))
                du += before.T @ dm
                back = back * z + dm @ u.T
            gates = gates[:-1]
            g[f"U{side}"], g[f"W{side}"], g[f"c{side}"] = du, x.T @ gates, gates.sum(axis=0)
            dx += gates @ p[f"W{side}"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], row, dx[:, :WORD_DIM])
        g["word"][0] = 0
        length = np.diff(words.tri_first)
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], words.tri, np.repeat(dx[:, WORD_DIM:] / length[:, None], length, axis=0))
        return g

    def logits(self, words: Words, ids: np.ndarray) -> np.ndarray:
        x, _ = self.inputs(words)
        return np.concatenate([self.forward(x, ids[i : i + 2048]) for i in range(0, len(ids), 2048)]) if len(ids) else np.zeros(0)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The calibrated highest window score of each text."""
        out = np.zeros(len(offs) - 1)
        for at, to in tk.chunks(offs):
            words = Words(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
            ids, text = words.windows()
            if len(ids):
                top = np.full(to - at, -np.inf)
                np.maximum.at(top, text, self.logits(words, ids))
                out[at:to] = np.where(np.isfinite(top), sigmoid(self.slope * top + self.shift), 0.0)
        return out


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seeded: bool = True) -> Net | None:
    """A fitted network; None where the sample doesn't hold both labels.

    ``seeded``: a word's first component starts at half its log odds, else at 0.
    """
    y = np.array(toxic, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(11)
    words = Words(*tk.utf8(pa.array(texts)))
    seen = np.unique(np.stack((np.repeat(np.arange(len(y)), np.diff(words.first)), words.of), 1), axis=0)
    pos, neg = (np.bincount(seen[y[seen[:, 0]] == c, 1], minlength=len(words.hash)) for c in (1, 0))
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
    odds *= (pos + neg) / (pos + neg + 4.0)  # words seen a few times only say little
    best = np.argsort(-np.abs(odds) - 1e-9 * (pos + neg), kind="stable")[:VOCABULARY]
    best = np.sort(best[(pos + neg)[best] >= 3])
    net = Net(words.hash[best], (odds[best] / 2 * seeded).astype(np.float32))

    ids, text = words.windows()
    if not len(ids):
        return None
    clean = np.flatnonzero(y[text] == 0)
    guess = np.concatenate((np.where(pos + neg >= 3, np.maximum(odds, 0), 0), [0]))[ids].sum(axis=1)
    bad = np.flatnonzero(y[text] == 1)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    turn = 0
    epoch = 0
    while epoch < epochs or turn < STEPS:  # so many passes at least, and on little data so many steps
        epoch += 1
        if epoch > 1:
            guess = np.zeros(len(ids))
            guess[bad] = net.logits(words, ids[bad])
        order = bad[np.lexsort((-guess[bad], text[bad]))]
        chosen = order[np.concatenate(([True], text[order][1:] != text[order][:-1]))]
        rows = rng.permutation(np.concatenate((clean, chosen)))
        weight = np.where(y[text[rows]] == 1, min(10.0, 0.5 * len(clean) / len(chosen)), 1.0)
        for i in range(0, len(rows), BATCH):
            part = rows[i : i + BATCH]
            few, own = words.only(ids[part])
            x, row = net.inputs(few)
            g = net.step(x, row, few, own, y[text[part]], weight[i : i + BATCH])
            turn += 1
            for k, grad in g.items():
                m, v = moment[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.p[k] -= (RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)

    # Calibration: the share of toxic texts as a logistic function of the highest logit.
    top = np.full(len(y), -20.0)
    np.maximum.at(top, text, net.logits(words, ids))
    scale, slope, shift = max(1e-6, float(np.std(top))), 1.0, 0.0
    z = (top - top.mean()) / scale
    for _ in range(50):  # Newton's method with a small ridge
        q = sigmoid(slope * z + shift)
        r = q * (1 - q) + 1e-6
        grad = np.array([((q - y) * z).sum() + 0.01 * slope, (q - y).sum()])
        hess = np.array([[(r * z * z).sum() + 0.01, (r * z).sum()], [(r * z).sum(), r.sum()]])
        slope, shift = np.array([slope, shift]) - np.clip(np.linalg.solve(hess, grad), -2, 2)
    slope = max(slope, 1e-3)
    net.slope, net.shift = float(slope / scale), float(shift - slope * top.mean() / scale)
    return net


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Net | None:
    """Train on the labelled rows of ``docs`` that aren't held out."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("quill_id"), F.col(label_col).alias("quill_y"), F.xxhash64(id_col).alias("h"))
    texts, marks = [], []
    for mark, rows in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        ids = known.where(F.col("quill_y") == mark).orderBy("h", "quill_id").limit(rows).select("quill_id").distinct()
        found = docs.join(F.broadcast(ids), F.col(id_col) == F.col("quill_id"), "left_semi").where(F.octet_length(F.col(text_col)) <= ROW_BYTES)
        one = found.groupBy(F.col(id_col).alias("quill_id")).agg(F.min(F.col(text_col)).alias("quill_text"))
        got = one.orderBy(F.xxhash64("quill_id")).select("quill_text").collect()  # so many rows at most
        texts += [r[0] for r in got]
        marks += [mark] * len(got)
        del got
    net = train(texts, marks)
    del texts
    tk.release()
    return net


def with_scores(docs: DataFrame, net: Net | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each row's text; a column that has the score's name is replaced."""
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != name]
    docs = docs.select(*kept)
    place, names = kept.index(text_col), [*kept, name]

    def run(batches):
        for batch in batches:
            score = net.scores(*tk.utf8(batch.column(place))) if net is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=names)
        tk.release()

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, learned from the labels table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_scores(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
