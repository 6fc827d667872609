"""Suffix stripping of English words (the published algorithm of 1980) as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the algorithm: suffixes and what takes their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

# A y after a consonant is a vowel; the others are written Y while a word is worked on.
_V, _C = "[aeiouy]", "[^aeiouy]"
_MORE_THAN_0, _MORE_THAN_1 = f"^{_C}*{_V}+{_C}", f"^{_C}*{_V}+{_C}+{_V}+{_C}"
_EXACTLY_1, _SHORT = f"^{_C}*{_V}+{_C}+{_V}*$", f"{_C}{_V}[^aeiouywxY]$"


def once(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.transform(F.array(value), f).getItem(0)


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _suffixes(w: Column, table: dict[str, str], allowed) -> Column:
    """The longest suffix of the table is replaced if what stands before it is allowed."""
    out = None
    for suffix in sorted(table, key=len, reverse=True):
        base = _cut(w, len(suffix))
        new = F.when(allowed(base, suffix), F.concat(base, F.lit(table[suffix]))).otherwise(w)
        out = F.when(w.endswith(suffix), new) if out is None else out.when(w.endswith(suffix), new)
    return out.otherwise(w)


def _step_1a(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)).when(w.endswith("ss"), w).when(w.endswith("s"), _cut(w, 1)).otherwise(w)


def _mended(w: Column) -> Column:
    double = w.rlike(r"([^aeiouylsz])\1$")
    return (
        F.when(w.endswith("at") | w.endswith("bl") | w.endswith("iz"), F.concat(w, F.lit("e")))
        .when(double, _cut(w, 1))
        .when(w.rlike(_EXACTLY_1) & w.rlike(_SHORT), F.concat(w, F.lit("e")))
        .otherwise(w)
    )


def _step_1b(w: Column) -> Column:
    past = lambda n: F.when(_cut(w, n).rlike(_V), _mended(_cut(w, n))).otherwise(w)
    return F.when(w.endswith("eed"), F.when(_cut(w, 3).rlike(_MORE_THAN_0), _cut(w, 1)).otherwise(w)).when(w.endswith("ed"), past(2)).when(w.endswith("ing"), past(3)).otherwise(w)


def _step_1c(w: Column) -> Column:
    return F.when(w.rlike("[yY]$") & _cut(w, 1).rlike(_V), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _step_5(w: Column) -> Column:
    base = _cut(w, 1)
    short = base.rlike(_EXACTLY_1) & ~base.rlike(_SHORT)
    ended = F.when(w.endswith("e") & (base.rlike(_MORE_THAN_1) | short), base).otherwise(w)
    return once(ended, lambda x: F.when(x.endswith("ll") & x.rlike(_MORE_THAN_1), _cut(x, 1)).otherwise(x))


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two letters, and those with other characters than a-z, stay."""
    more = lambda base, suffix: base.rlike(_MORE_THAN_0)
    much = lambda base, suffix: base.rlike(_MORE_THAN_1) & (base.rlike("[st]$") if suffix == "ion" else F.lit(True))
    steps = [
        lambda w: F.regexp_replace(w, "^y", "Y"),
        lambda w: F.regexp_replace(w, "([aeiou])y", "$1Y"),
        _step_1a,
        _step_1b,
        _step_1c,
        lambda w: _suffixes(w, STEP_2, more),
        lambda w: _suffixes(w, STEP_3, more),
        lambda w: _suffixes(w, dict.fromkeys(STEP_4, ""), much),
        _step_5,
        F.lower,
    ]
    return F.when(word.rlike("^[a-z]{3,}$"), reduce(once, steps, word)).otherwise(word)
