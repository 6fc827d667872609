"""String likeness from 0 to 100: normalised indel ratio and its best partial alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & where.get(c, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer of at most its length."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n = len(short)
    return max(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def ratio_udf(keyword: str):
    """Column function: the best ratio of a keyword with any string of an array."""

    @F.pandas_udf("double")
    def best(items: pd.Series) -> pd.Series:
        return pd.Series([max((ratio(keyword.lower(), x.lower()) for x in xs if x is not None), default=0.0) if xs is not None else 0.0 for xs in items])

    return best


def partial_udf(keyword: str, least: float = 0.0):
    """Column function: the partial ratio of a keyword with a lower-cased text, 0 where it is below ``least`` or the text is null.

    Only what has to be aligned leaves the JVM.  A text that holds the keyword has 100.  A stretch that isn't equal to the
    keyword lacks a character of n, at the text's edge at best: 2(n - 1) / (2n - 1).  Where that is below ``least``, texts as
    long as the keyword are done with, and only shorter ones are aligned.
    """
    word = keyword.lower()
    equal_only = len(word) > 0 and 200.0 * (len(word) - 1) / (2 * len(word) - 1) < least

    @F.pandas_udf("double")
    def aligned(text: pd.Series) -> pd.Series:
        def one(t):
            score = 0.0 if t is None else partial_ratio(word, t)
            return score if score >= least else 0.0

        return pd.Series([one(t) for t in text], dtype="float64")

    def best(low: Column) -> Column:
        holds = F.contains(low, F.lit(word)) if word else low == ""
        open_ = ~holds & (F.length(low) < len(word)) if equal_only else ~holds
        return F.when(holds, 100.0).otherwise(aligned(F.when(open_, low)))

    return best


def common_characters(left, right) -> np.ndarray:
    """For each pair of strings, at least as much as their longest common subsequence: shared characters in 64 classes."""
    bags = np.zeros((2, len(left), 64), np.int32)
    for side, texts in enumerate((left, right)):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % 64
        np.add.at(bags[side], (np.repeat(np.arange(len(texts)), size), codes), 1)
    return np.minimum(bags[0], bags[1]).sum(axis=1)


def alike(left: Column, right: Column, least: float) -> Column:
    """The ratio of two strings where it is ``least`` or more, else null; only pairs whose character counts allow it are aligned."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        for at in range(0, len(a), 4096):
            x, y = a.iloc[at : at + 4096].fillna("").tolist(), b.iloc[at : at + 4096].fillna("").tolist()
            total = np.array([len(s) + len(t) for s, t in zip(x, y, strict=True)])
            bound = np.where(total == 0, 100.0, 200.0 * common_characters(x, y) / np.maximum(total, 1))
            for i in np.flatnonzero(bound >= least):
                score = ratio(x[i], y[i])
                out[at + i] = score if score >= least else np.nan
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return run(left, right)
