"""Markdown, reStructuredText and plain text: blocks, tables, images, sections and chunks."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.code import code_metadata
from quillspark.functions.jsontext import is_json_like

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^\s`]*)[^`]*$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_NUMBER = re.compile(r"^(\d+(?:\.\d+)*)\.?\s+(.*)$")
_SECTION = re.compile(r"^\*\*(\d+(?:\.\d+)*)\.?\s+(.*?)\*\*\s*$", re.M)


def plain(text: str) -> str:
    """Links and emphasis reduced to their words."""
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    return re.sub(r"(\*\*|__|\*|`)(.+?)\1", r"\2", text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def clean_title(title: str, ascii_only: bool = False) -> str:
    """NFC, no control characters, trimmed; an empty title gets a name."""
    if re.search("[ÃÂ][\u0080-¿]", title):
        try:
            title = title.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    t = "".join(c for c in unicodedata.normalize("NFC", title) if unicodedata.category(c)[0] != "C")
    if ascii_only:
        t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    return t.strip() or "Unnamed Section"


def events(text: str):
    """(kind, first line, last line, content, tag): fence, heading or text line, in order."""
    lines, i = (text or "").splitlines(), 0
    while i < len(lines):
        if m := _FENCE.match(lines[i]):
            mark, j = m[1], i + 1
            while j < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$", lines[j]):
                j += 1
            yield "fence", i + 1, min(j + 1, len(lines)), "\n".join(lines[i + 1 : j]), m[2] or None
            i = j + 1
            continue
        if m := _HEADING.match(lines[i]):
            yield "heading", i + 1, i + 1, m[2], str(len(m[1]))
        elif lines[i].strip():
            yield "text", i + 1, i + 1, lines[i].strip(), None
        i += 1


def markdown_blocks(text: str | None) -> list[dict]:
    """Fences as code (as JSON where tagged so and valid), runs of text lines as text, by line."""
    out, run = [], []

    def flush():
        if run:
            content = plain(" ".join(c for _, c in run)).strip()
            if content:
                out.append({"type": "text", "content": content, "language": None, "block_type": "text", "start_line": run[0][0], "end_line": run[-1][0]})
            run.clear()

    for kind, first, last, content, tag in events(text or ""):
        if kind == "fence":
            flush()
            if content.strip():
                valid = (tag or "").lower() == "json" and is_json_like(content)
                out.append({"type": "json" if valid else "code", "content": content, "language": tag, "block_type": "fenced", "start_line": first, "end_line": last})
        else:
            if run and (kind == "heading" or first - run[-1][0] >= 2):
                flush()
            run.append((first, content))
            if kind == "heading":
                flush()
    flush()
    return out


class Hierarchy:
    """The open sections: one closes when the next isn't below it."""

    def __init__(self):
        self.stack: list[tuple[tuple[int, ...], str, str]] = []

    def enter(self, number: tuple[int, ...], title: str) -> None:
        while self.stack and not (len(self.stack[-1][0]) < len(number) and number[: len(self.stack[-1][0])] == self.stack[-1][0]):
            self.stack.pop()
        name = f"{'.'.join(map(str, number))} {title}".strip()
        self.stack.append((number, name, sha(name)))

    def titles(self):
        return [x[1] for x in self.stack]

    def hashes(self):
        return [x[2] for x in self.stack]


def markdown_chunks(text: str | None, file_path: str = "") -> list[dict]:
    """Each fence with the text before it and its section path; headings count up where unnumbered."""
    tree, counts, last, out = Hierarchy(), [], [], []
    for kind, first, end, content, tag in events(text or ""):
        if kind == "heading":
            level, title = int(tag), clean_title(content)
            if m := _NUMBER.match(title):
                number, title = tuple(map(int, m[1].split("."))), m[2]
            else:
                counts[:] = (counts + [0] * level)[:level]
                counts[-1] += 1
                number = tuple(counts)
            tree.enter(number, title)
            last = []
        elif kind == "text":
            last.append((first, content))
        elif content.strip():
            out.append(
                {
                    "file_path": file_path,
                    "code": content,
                    "code_type": tag or "text",
                    "description": plain(" ".join(c for _, c in last)),
                    "code_start": first,
                    "code_end": end,
                    "section_id": sha(content),
                    "section_path": tree.titles(),
                    "section_hash_path": tree.hashes(),
                    "functions": code_metadata(content, tag)["functions"],
                }
            )
            last = []
    return out


def rst_content(text: str | None) -> list[dict]:
    """A reStructuredText file as blocks: its code with the paragraph before each; a file without code is one text block."""
    out = []
    for b in rst_blocks(text, None):
        if b["description"]:
            out.append({"type": "text", "content": b["description"], "language": None, "block_type": "description", "start_line": None, "end_line": None})
        out.append({"type": "code", "content": b["code"], "language": b["language"], "block_type": "literal", "start_line": b["start_line"], "end_line": b["end_line"]})
    if not out and (text or "").strip():
        out = [{"type": "text", "content": text, "language": None, "block_type": "file", "start_line": 1, "end_line": text.count("\n") + 1}]
    return out


def rst_blocks(text: str | None, most: int | None = 50 * 1024) -> list[dict]:
    """Literal blocks and code directives with the paragraph before; texts over ``most`` bytes give none (None: all do)."""
    if not text or (most is not None and len(text.encode()) > most):
        return []
    lines, out, i, before = text.splitlines(), [], 0, ""
    while i < len(lines):
        line = lines[i]
        directive = re.match(r"^(\s*)\.\. (?:code-block|code|sourcecode)::\s*(\S*)", line)
        if directive or (line.rstrip().endswith("::") and not line.lstrip().startswith("..")):
            indent, j = len(line) - len(line.lstrip()), i + 1
            while j < len(lines) and (not lines[j].strip() or (directive and re.match(r"^\s+:\w+:", lines[j]))):
                j += 1
            start = j
            while j < len(lines) and (not lines[j].strip() or len(lines[j]) - len(lines[j].lstrip()) > indent):
                j += 1
            body = lines[start:j]
            while body and not body[-1].strip():
                body.pop()
            if body:
                margin = min(len(x) - len(x.lstrip()) for x in body if x.strip())
                code = "\n".join(x[margin:] for x in body)
                said = before if directive else line.strip().removesuffix("::").strip() or before
                if code not in [b["code"] for b in out]:
                    out.append({"code": code, "language": (directive[2] if directive else "") or "text", "description": said, "start_line": start + 1, "end_line": start + len(body), "section_id": sha(code)})
                before = said
            i = j
            continue
        if line.strip() and not re.fullmatch(r"([=\-~^\"'`#*+.:_])\1{2,}", line.strip()):  # a title's rule is no paragraph
            before = line.strip()
        i += 1
    return out


def notebook_blocks(text: str | None) -> list[dict]:
    """A notebook's cells that aren't blank, one block each, by line of all cells' sources; other texts are one block."""
    try:
        book = json.loads(text or "")
        cells = [(str(c["cell_type"]), c["source"] if isinstance(c["source"], str) else "".join(c["source"])) for c in book["cells"]]
        about = book.get("metadata") or {}
        language = (about.get("language_info") or {}).get("name") or (about.get("kernelspec") or {}).get("language") or "python"
    except (ValueError, KeyError, TypeError, AttributeError):
        whole = {"type": "text", "content": text, "language": None, "block_type": "file", "start_line": 1, "end_line": (text or "").count("\n") + 1}
        return [whole] if (text or "").strip() else []
    out, line = [], 1
    for kind, source in cells:
        last = line + source.count("\n")
        if source.strip():
            code = kind == "code"
            out.append({"type": "code" if code else "text", "content": source, "language": language if code else None, "block_type": "cell", "start_line": line, "end_line": last})
        line = last + 1
    return out


def sections(text: str | None) -> list[dict]:
    """Parts that start with a line **N.N Title**, with paths; the whole text where there is none."""
    text, out, tree = text or "", [], Hierarchy()
    marks = list(_SECTION.finditer(text))
    if not marks:
        return [{"number": None, "title": None, "content": text, "start_line": 1, "path": [], "hashes": []}] if text.strip() else []
    for m, after in zip(marks, [*marks[1:], None], strict=True):
        tree.enter(tuple(map(int, m[1].split("."))), clean_title(m[2]))
        body = text[m.end() : after.start() if after else len(text)].strip("\n")
        out.append({"number": m[1], "title": clean_title(m[2]), "content": body, "start_line": text.count("\n", 0, m.start()) + 1, "path": tree.titles(), "hashes": tree.hashes()})
    return out


def pack(sentences: Column, count, most: int = 500, text=lambda s: s, counted: bool = False) -> Column:
    """Sentences joined to chunks of at most ``most`` tokens; a longer sentence stands alone.

    ``count`` and ``text`` take an element: a sentence, or a struct that holds one beside its count.  With ``counted`` a chunk
    is a struct (chunk, n) with the sum of its sentences' tokens.
    """
    kind = "array<struct<chunk:string,n:int>>" if counted else "array<string>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))
    closed = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["open"].alias("chunk"), acc["n"].alias("n")) if counted else acc["open"]))

    def step(acc, s):
        n = count(s)
        full = (acc["open"] != "") & (acc["n"] + n > most)
        return F.struct(
            F.when(full, closed(acc)).otherwise(acc["done"]).cast(kind).alias("done"),
            F.when(full, F.concat(text(s), F.lit("\n"))).otherwise(F.concat(acc["open"], text(s), F.lit("\n"))).alias("open"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    return F.aggregate(sentences, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(closed(acc)))


def table_rows(text: Column) -> Column:
    """Rows of a markdown table, the header first: null unless it has a rule line; odd widths go."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rule = F.get(lines, F.lit(1)).rlike(r"^\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?$")
    body = F.filter(F.transform(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), cells), lambda r: F.size(r) == F.size(cells(F.get(lines, F.lit(0)))))
    return F.when((F.size(lines) >= 2) & rule, F.concat(F.array(cells(F.get(lines, F.lit(0)))), body))


def image(text: Column) -> Column:
    """struct(alt, url) of the first markdown image."""
    url = F.regexp_extract(text, r"!\[([^\]]*)\]\(([^)\s]+)", 2)
    return F.when(url != "", F.struct(F.regexp_extract(text, r"!\[([^\]]*)\]\(([^)\s]+)", 1).alias("alt"), url.alias("url")))


def page_number(line: Column) -> Column:
    return F.regexp_extract(line, r"<!--\s*[Pp]age\s*:?\s*([0-9]+)\s*-->", 1).try_cast("int")


def elements(text: str | None) -> list[dict]:
    """Text, image, table and code elements of converted markdown, with page and section."""
    out, page, tree, run, counts = [], 1, Hierarchy(), [], []

    def add(kind, content, first, last):
        out.append({"type": kind, "content": content, "start_line": first, "end_line": last, "page": page, "section_path": tree.titles(), "section_id": sha(content)})

    def flush():
        if not run:
            return
        lines = [c for _, c in run]
        is_table = len(lines) >= 2 and "|" in lines[0] and re.match(r"^\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?$", lines[1])
        add("table" if is_table else "text", "\n".join(lines), run[0][0], run[-1][0])
        run.clear()

    for kind, first, last, content, tag in events(text or ""):
        mark = re.match(r"<!--\s*[Pp]age\s*:?\s*([0-9]+)\s*-->", content) if kind == "text" else None
        if kind != "text" or mark or (run and first - run[-1][0] >= 2):
            flush()
        if mark:
            page = int(mark[1])
        elif kind == "heading":
            level = int(tag)
            counts[:] = (counts + [0] * level)[:level]
            counts[-1] += 1
            tree.enter(tuple(counts), clean_title(content))
        elif kind == "fence":
            add("code", content, first, last)
        elif m := re.match(r"!\[([^\]]*)\]\(([^)\s]+)", content):
            flush()
            add("image", m[2], first, last)
        else:
            run.append((first, content))
    flush()
    return out


BLOCK = "array<struct<type:string,content:string,language:string,block_type:string,start_line:int,end_line:int>>"
SECTION = "array<struct<number:string,title:string,content:string,start_line:int,path:array<string>,hashes:array<string>>>"
CHUNK = "array<struct<file_path:string,code:string,code_type:string,description:string,code_start:int,code_end:int,section_id:string,section_path:array<string>,section_hash_path:array<string>,functions:array<string>>>"
RST = "array<struct<code:string,language:string,description:string,start_line:int,end_line:int,section_id:string>>"
ELEMENT = "array<struct<type:string,content:string,start_line:int,end_line:int,page:int,section_path:array<string>,section_id:string>>"


def rows_udf(f, kind: str):
    """A list-of-dicts function as an Arrow UDF for ``explode``."""

    @F.pandas_udf(kind)
    def run(text: pd.Series) -> pd.Series:
        return text.map(f)

    return run
