"""Text predicates and projections as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and their plain forms, for ``fold``.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column, fold: bool = False) -> Column:
    """Lower-cased runs of letters and digits, accents folded on request; null gives an empty list."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.translate(low, ACCENTED, PLAIN) if fold else low
    return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def clean_keywords(keywords) -> list[str]:
    return [k.strip().lower() for k in keywords or [] if k and k.strip()]


def contains_all(text: Column, keywords) -> Column:
    """Every keyword stands in the text, case aside; no keyword left is true, a null text false."""
    tests = [F.contains(F.lower(text), F.lit(k)) for k in clean_keywords(keywords)]
    return F.coalesce(reduce(lambda a, b: a & b, tests, text.isNotNull()), F.lit(False))


def keyword_fraction(text: Column, keywords) -> Column:
    """Distinct keywords found over all keywords given, which may repeat."""
    given = [k.lower() for k in keywords]
    found = [F.contains(F.lower(text), F.lit(k)).cast("int") for k in sorted(set(given))]
    return F.coalesce(reduce(lambda a, b: a + b, found, F.lit(0)) / F.lit(float(max(1, len(given)))), F.lit(0.0))


def has_all_tags(tags: Column, wanted) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), tags)) == 0


def tag_overlap(tags: Column, wanted) -> Column:
    return F.size(F.array_intersect(tags, F.array(*[F.lit(t) for t in wanted])))


def like_any(fields, keyword: str) -> Column:
    """Case-insensitive LIKE on any field; % and _ in the keyword are wildcards."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(f).like(f"%{keyword.lower()}%"), F.lit(False)) for f in fields])


def preview(text: Column, size: int = 500) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def log_safe(text: Column, most: int = 100) -> Column:
    """Long strings as head...tail; the header of inline base64 data is kept whole."""
    half = most // 2
    cut = lambda t: F.concat(F.substring(t, 1, half), F.lit("..."), F.substring(t, -half, half))
    head = F.regexp_extract(text, r"^(data:[a-z]+/[a-z0-9.+-]+;base64,)", 1)
    body = F.substring(text, F.length(head) + 1, F.length(text))
    return F.when(F.length(text) <= most, text).when((head != "") & (F.length(body) > most), F.concat(head, cut(body))).otherwise(cut(text))


def log_safe_list(items: Column, most: int = 10) -> Column:
    return F.when(F.size(items) > most, F.concat(F.lit("[<"), F.size(items).cast("string"), F.lit(" items>]"))).otherwise(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))


def first_line(text: Column) -> Column:
    return F.split(text, "\n").getItem(0)


def embedding_text(*parts: Column) -> Column:
    """Non-empty parts, a line each, trimmed."""
    return F.trim(F.concat_ws("\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts]))


def token_count(text: Column) -> Column:
    """Words and single marks, a stand-in for a model's tokenizer."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")), F.lit(0))


def truncate_tokens(text: Column, most: int) -> Column:
    """At most ``most`` words: the first and the last half of them around an ellipsis."""
    words, half = F.filter(F.split(text, r"\s+"), lambda w: w != ""), most // 2
    return F.when(F.size(words) <= most, F.array_join(words, " ")).otherwise(
        F.concat(F.array_join(F.slice(words, 1, half), " "), F.lit(" ... "), F.array_join(F.slice(words, F.size(words) - half + 1, half), " "))
    )


def cell_text(cell: Column) -> Column:
    """A table cell on one line."""
    return F.trim(F.regexp_replace(cell, r"\s*[\r\n]+\s*", " "))


def cell_number(cell: Column) -> Column:
    return F.try_cast(F.regexp_replace(cell, ",", ""), "double") if hasattr(F, "try_cast") else F.regexp_replace(cell, ",", "").try_cast("double")


def squeeze(text: Column) -> Column:
    """White space collapsed, closed by a full stop."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when((t == "") | t.endswith("."), t).otherwise(F.concat(t, F.lit(".")))
