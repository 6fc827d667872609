"""Token counts and ids by a byte-level vocabulary of merge ranks."""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

FILE = "byte_bpe_50k.tiktoken"
#: Words of which a task keeps the ids; beyond that it starts anew.
KEPT = 200_000


class Vocabulary:
    """A rank file: a token's bytes in base 64 and its id, a line each; read on the driver and sent to the tasks."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        if path is None or pattern is None:
            import public_tokenizers as public

            path, pattern = path or public.path(FILE), pattern or public.PATTERN
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = pattern

    def ids(self, word: bytes) -> list[int]:
        """A word's ids: the adjacent pair whose bytes have the lowest rank merges, the leftmost of equals first."""
        if word in self.ranks:
            return [self.ranks[word]]
        n, rank = len(word), self.ranks.get
        start, after, before = list(range(n)), [*range(1, n), n], [*range(-1, n - 1)]
        end = list(range(1, n + 1))
        pairs = [(r, i) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        current: list[int | None] = [rank(word[i : i + 2]) for i in range(n - 1)] + [None]
        heapq.heapify(pairs)
        while pairs:
            r, i = heapq.heappop(pairs)
            if current[i] != r:
                continue
            j = after[i]
            end[i], after[i], current[j] = end[j], after[j], None
            start[j] = -1
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0:
                    b = after[a]
                    current[a] = rank(word[start[a] : end[b]]) if b < n else None
                    if current[a] is not None:
                        heapq.heappush(pairs, (current[a], a))
        return [self.ranks[word[start[i] : end[i]]] for i in range(n) if start[i] >= 0]


def _worker(vocabulary: Vocabulary, of=lambda ids: ids):
    """A function from a text to what ``of`` makes of each word's ids, in order; distinct words are merged once."""
    words, known = regex.compile(vocabulary.pattern), {}

    def parts(text: str) -> list:
        found = words.findall(text)
        new = [w for w in set(found) if w not in known]
        if new:
            if len(known) > KEPT:
                known.clear()
                new = set(found)
            known.update((w, of(vocabulary.ids(w.encode()))) for w in new)
        return list(map(known.__getitem__, found))

    return parts


def ids(text: Column, vocabulary: Vocabulary) -> Column:
    """The ids of each text; null stays null."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        parts = _worker(vocabulary)
        return texts.map(lambda t: None if t is None else list(chain.from_iterable(parts(t))))

    return run(text)


def count(text: Column, vocabulary: Vocabulary) -> Column:
    """The number of tokens of each text; null stays null."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        parts = _worker(vocabulary, len)
        return pd.Series([None if t is None else sum(parts(t)) for t in texts], dtype="Int32")

    return run(text)


def counts(texts: Column, vocabulary: Vocabulary) -> Column:
    """The number of tokens of each string of an array (a null string has none)."""

    @F.pandas_udf("array<int>")
    def run(rows: pd.Series) -> pd.Series:
        parts = _worker(vocabulary, len)
        return rows.map(lambda row: None if row is None else [sum(parts(t)) if t else 0 for t in row])

    return run(texts)
