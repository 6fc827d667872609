"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of byte n-grams, for n from 2
to 4, that stand in both (A-Z lower-cased; n-grams are hashed to 2**16 columns), divided by
the root of both texts' own numbers.  Nyström landmarks span the feature space, and one ridge
regression for each language, one against the rest, is fitted in it.  As a text's kernel row
is its presence row times the landmarks' presence, the landmarks, their inverse root and the
regressions fold into one matrix; a batch of texts is scored by one matrix product.

Fitted on at most ``PER_LANG`` documents of each language, those with the lowest id hashes; of
rows that share id and language on one, and on no text of more than ``ROW_BYTES``, so that the
driver holds a bounded sample.
Texts that are null or hold no letter get ``und`` with score 0; so does every text where
nothing could be learned.  Whole texts are used, of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.shared import bound_batches

COLUMNS, ORDERS = 1 << 16, (2, 3, 4)
PER_LANG, ROW_BYTES, LANDMARKS, EACH, RIDGE, SHARPNESS = 400, 1 << 18, 160, 8, 1e-3, 8.0
#: Texts of one matrix product.
ROWS = 64
_ODD = {2: np.uint32(0x9E3779B1), 3: np.uint32(0x85EBCA77), 4: np.uint32(0xC2B2AE3D)}


def presence(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row for each text: 1 in the columns of its n-grams."""
    out = np.zeros((len(offs) - 1, COLUMNS), dtype=np.float32)
    flat, n = out.reshape(-1), len(data)
    low = tk.LOWER[data].astype(np.uint32)
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int64) * COLUMNS, np.diff(offs))
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(n)
    code = low.copy()
    for size in range(2, max(ORDERS) + 1):
        if n < size:
            break
        code = code[: n - size + 1] | (low[size - 1 :] << np.uint32(8 * (size - 1)))
        if size in ORDERS:
            column = ((code * _ODD[size]) >> np.uint32(16)).astype(np.int64)
            inside = left[: n - size + 1] >= size
            flat[(row[: n - size + 1] + column)[inside]] = 1
    return out


def _batches(data: np.ndarray, offs: np.ndarray):
    """Presence rows of a few texts at a time; a very long text stands alone."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = min(n, at + ROWS, max(at + 1, int(np.searchsorted(offs, offs[at] + (1 << 20), side="right")) - 1))
        yield at, to, presence(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


class Model:
    """The folded matrix and the languages of its columns."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray):
        self.langs, self.weights, self.bias = langs, weights, bias

    def scores(self, rows: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(rows.sum(1), 1))
        return (rows @ self.weights) / own[:, None] + self.bias

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language's index and its share, for each text."""
        best, share = np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1)
        for at, to, rows in _batches(data, offs):
            raw = SHARPNESS * self.scores(rows)
            p = np.exp(raw - raw.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best[at:to] = p.argmax(axis=1)
            share[at:to] = p.max(axis=1)
        return best, share


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Landmarks are taken from all languages in turn, so that each has ``EACH`` of them or more."""
    if not texts:
        return None
    names = sorted(set(langs))
    label = np.array([names.index(x) for x in langs])
    data, offs = tk.utf8(pa.array(texts))
    place = np.zeros(len(label), np.int64)
    for c in range(len(names)):
        place[label == c] = np.arange((label == c).sum())
    marks = np.lexsort((label, place))[: max(landmarks, EACH * len(names))]
    basis = np.concatenate([presence(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]])) for i in marks])
    basis /= np.sqrt(np.maximum(basis.sum(1), 1))[:, None]
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    kernel = np.concatenate([(rows @ basis.T) / np.sqrt(np.maximum(rows.sum(1), 1))[:, None] for _, _, rows in _batches(data, offs)])
    features = kernel @ root
    y = np.where(label[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    mean, centre = y.mean(0), features.mean(0)
    x = features - centre
    w = np.linalg.solve(x.T @ x + ridge * len(x) * np.eye(x.shape[1]), x.T @ (y - mean))
    return Model(names, (basis.T @ (root @ w)).astype(np.float32), (mean - centre @ w).astype(np.float32))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn, per_lang: int = PER_LANG) -> list:
    """At most ``per_lang`` learnable (text, lang) rows of each language, by the lowest id hashes."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))
    # Ahead of the ranking, a threshold on the hash leaves a few times per_lang rows of a language.
    counts = rows.groupBy("lang").count()  # a row for each language
    share = F.least(F.lit(1.0), F.lit(4.0 * per_lang) / F.col("count"))
    near = rows.join(F.broadcast(counts), "lang").where((F.col("h") / F.lit(2.0**64)) + 0.5 <= share)
    order = Window.partitionBy("lang").orderBy("h", "id")
    ids = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang).select(F.col("id").alias("quill_id")).distinct()
    found = docs.join(F.broadcast(ids), F.col(id_col) == F.col("quill_id"), "left_semi")
    found = found.where(F.col(lang_col).isNotNull() & (F.octet_length(F.col(text_col)) <= ROW_BYTES))
    one = found.groupBy(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).agg(F.min(F.col(text_col)).alias("text"))
    return one.orderBy(F.xxhash64("id"), "lang").select("text", "lang").collect()


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _label(model: Model | None):
    def run(batches):
        for batch in batches:
            text = batch.column(1)
            data, offs = tk.utf8(text)
            letter = np.zeros(len(data) + 1, np.int64)
            np.cumsum((tk.LOWER[data] >= 97) & (tk.LOWER[data] <= 122), out=letter[1:])
            ascii_letters = letter[offs[1:]] > letter[offs[:-1]]
            has = [bool(a) or any(c.isalpha() for c in (text[i].as_py() or "")) for i, a in enumerate(ascii_letters)]
            if model is None:
                lang, share = ["und"] * len(has), np.zeros(len(has))
            else:
                best, share = model.predict(data, offs)
                lang = [model.langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
                share = np.where(has, share, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(share.astype(np.float64))], names=["id", "held_out", "lang_pred", "score"])
        tk.release()

    return run


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row; rows held out or without id aren't learned from."""
    bound_batches(docs.sparkSession)
    learn = ~held_out(id_col) & F.col(id_col).isNotNull()
    got = sample(docs, id_col, text_col, lang_col, learn)
    model = fit([r["text"] for r in got], [r["lang"] for r in got])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    return rows.mapInArrow(_label(model), "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
