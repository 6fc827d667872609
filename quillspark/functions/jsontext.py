"""JSON inside text: recognition, repair and structure search."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.arrow import arrow_udf


def is_json_like(text: str | None) -> bool:
    """An object or array that parses; bare scalars aren't."""
    t = (text or "").strip()
    if not ((t.startswith("{") and t.endswith("}")) or (t.startswith("[") and t.endswith("]"))):
        return False
    try:
        json.loads(t)
    except (ValueError, RecursionError):
        return False
    return True


def distinct_terms(terms: Column) -> Column:
    """The terms of a list once each, sorted, nulls left out."""
    return F.array_sort(F.array_distinct(F.filter(terms, lambda t: t.isNotNull())))


def json_like(text: Column) -> Column:
    t = F.trim(text)
    closed = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    return F.coalesce(closed & F.try_parse_json(t).isNotNull(), F.lit(False))


def _repair(text: str) -> str:
    """Usual slips: single quotes, bare keys, trailing commas, Python constants, missing closers."""
    t = re.sub(r"'((?:[^'\\]|\\.)*)'", lambda m: json.dumps(m[1]), text)
    t = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', t)
    t = re.sub(r",\s*([}\]])", r"\1", t)
    t = re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", re.sub(r"\bNone\b", "null", t)))
    stack, quoted, escaped = [], False, False
    for c in t:
        if quoted:
            escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    closed = t.rstrip().removesuffix(",") if stack and not quoted else t
    return closed + '"' * quoted + "".join(reversed(stack))


def clean_json(text: str | None):
    """The parsed value; else of the outermost brackets; else repaired; else the text itself."""
    if text is None:
        return None
    tries = [text]
    if m := re.search(r"(\[.*\]|\{.*\})", text, re.S):
        tries.append(m[1])
    elif m := re.search(r"[\[{].*", text, re.S):  # cut off before its end
        tries.append(m[0])
    tries.append(_repair(tries[-1]))
    for t in tries:
        try:
            return json.loads(t)
        except (ValueError, RecursionError):
            continue
    return text


def walk(value):
    """(path, key, scalar) of all members: path like a.b[0].c; scalar is None for containers."""
    stack = [("", None, value)]
    while stack:
        path, key, x = stack.pop()
        scalar = None
        if isinstance(x, dict):
            stack.extend((f"{path}.{k}" if path else str(k), str(k), v) for k, v in reversed(list(x.items())))
        elif isinstance(x, list):
            stack.extend((f"{path}[{i}]", None, v) for i, v in reversed(list(enumerate(x))))
        elif x is not None:
            scalar = str(x)
        if path:
            yield path, key, scalar


def search(value, terms, mode: str) -> tuple[float, list[str], list[str]]:
    """Share of the terms found, the terms, and where; an unknown mode finds nothing.

    keys: equal to a key; values: inside a scalar; structure: all terms in order inside one path.
    """
    want = [t.lower() for t in terms if t]
    if not want or mode not in ("keys", "values", "structure"):
        return 0.0, [], []
    found, places = set(), set()
    for path, key, scalar in walk(value):
        if mode == "keys" and key is not None and key.lower() in want:
            found.add(key.lower())
            places.add(path)
        elif mode == "values" and scalar is not None:
            hit = {t for t in want if t in scalar.lower()}
            found |= hit
            places |= {path} if hit else set()
        elif mode == "structure":
            at, low = 0, path.lower()
            for t in want:
                at = low.find(t, at)
                if at < 0:
                    break
                at += len(t)
            else:
                return 1.0, sorted(set(want)), [path]
    return len(found) / len(set(want)), sorted(found), sorted(places)


RESULT = "struct<score:double,matched:array<string>,paths:array<string>>"


def search_udf(terms, mode: str):
    """Column function over JSON text; text that doesn't parse scores 0."""

    @F.pandas_udf(RESULT)
    def run(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            try:
                rows.append(search(json.loads(t), terms, mode) if t is not None else (0.0, [], []))
            except (ValueError, RecursionError):
                rows.append((0.0, [], []))
        return pd.DataFrame(rows, columns=["score", "matched", "paths"])

    return run


@arrow_udf("string")
def clean_json_udf(text: pd.Series) -> pd.Series:
    """JSON text of the cleaned value; the text itself where nothing parses."""

    def one(t):
        v = clean_json(t)
        return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    return text.map(one)
