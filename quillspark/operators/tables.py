"""Tables found on pages: geometry, quality scores, matching and merging."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); apart or without area 0."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def overlapping(left: DataFrame, right: DataFrame, threshold: float, key: str = "id", page: str = "page", box: str = "bbox") -> DataFrame:
    """Pairs on one page with an IoU above the threshold.

    With a threshold of 0 or more boxes are dealt to the cells of grids, a grid for each power of two of their larger side,
    so that a box touches four cells at most.  Boxes that overlap enough have sides within a factor of each other: a box
    is also dealt to the next few larger grids.  Boxes of a cell meet by an equi-join on page, grid and cell, and a pair is
    reported in one cell alone, that of its intersection's lower corner, so nothing has to be made distinct.
    """
    names = ("p", "left_id", "a"), ("p", "right_id", "b")
    rows = [t.select(*[F.col(c).alias(n) for c, n in zip((page, key, box), own, strict=True)]) for t, own in zip((left, right), names, strict=True)]
    if threshold < 0:
        joined = rows[0].join(rows[1], "p")
    else:
        away = _levels(rows, threshold)
        a_home, b_home = (_cells(r, c, 0, 0) for r, c in zip(rows, "ab", strict=True))
        # A pair meets in the grid of the larger box, where at least one of the two is at home.
        on = ["p", "grid", "cx", "cy"]
        if away:
            a_away, b_away = (_cells(r, c, 1, away) for r, c in zip(rows, "ab", strict=True))
            joined = a_home.join(b_home.unionAll(b_away), on).unionByName(a_away.join(b_home, on))
        else:
            joined = a_home.join(b_home, on)
        side = F.pow(F.lit(2.0), F.col("grid"))
        corner = lambda c: F.floor(F.greatest(F.col(f"a.{c}").cast("double"), F.col(f"b.{c}").cast("double")) / side)
        joined = joined.where((corner("x1") == F.col("cx")) & (corner("y1") == F.col("cy")))
    scored = joined.select(F.col("p").alias(page), "left_id", "right_id", iou(F.col("a"), F.col("b")).alias("iou"))
    return scored.where(F.col("iou") > threshold)


def _home(box: str) -> Column:
    """The grid of a box, null for one without area or with odd corners."""
    x1, y1, x2, y2 = (F.col(f"{box}.{c}").cast("double") for c in ("x1", "y1", "x2", "y2"))
    larger = F.greatest(x2 - x1, y2 - y1)
    plain = (x2 > x1) & (y2 > y1) & (F.greatest(F.abs(x1), F.abs(y1), F.abs(x2), F.abs(y2)) < 1e300)
    return F.when(plain, F.ceil(F.log2(larger)).cast("int"))


def _levels(rows: list[DataFrame], threshold: float) -> int:
    """How many grids two boxes with an IoU above the threshold can be apart.

    The intersection is at most min(w) * min(h), so min(w) > t * max(w), and the same for heights: larger sides differ by 1 / t
    at most.  The sizes that occur, one row of an aggregate, are a second bound: boxes of one size need their own grid alone.
    """
    homes = rows[0].select(_home("a").alias("h")).unionAll(rows[1].select(_home("b").alias("h")))
    low, high = homes.agg(F.min("h"), F.max("h")).first()
    span = 0 if low is None else high - low
    return min(span, max(1, math.ceil(math.log2(1 / threshold)))) if threshold > 0 else span


def _cells(boxes: DataFrame, box: str, first: int, last: int) -> DataFrame:
    """Boxes by (grid, cx, cy), from their own grid plus ``first`` to plus ``last``: at most four cells in each."""
    grids = boxes.withColumn("home", _home(box)).where("home is not null").withColumn("grid", F.explode(F.sequence(F.col("home") + first, F.col("home") + last))).drop("home")
    side = F.pow(F.lit(2.0), F.col("grid"))
    cell = lambda low, high: F.explode(F.sequence(F.floor(F.col(f"{box}.{low}") / side), F.floor(F.col(f"{box}.{high}") / side)))
    return grids.withColumn("cx", cell("x1", "x2")).withColumn("cy", cell("y1", "y2"))


def cross_validated(first: DataFrame, second: DataFrame, threshold: float = 0.5, key: str = "id", page: str = "page", box: str = "bbox") -> DataFrame:
    """Tables of one reading with the best matching table of another: (page, key, confirmed, match_id, iou)."""
    pairs = overlapping(first, second, threshold, key, page, box)
    best = pairs.groupBy(page, F.col("left_id").alias(key)).agg(F.max(F.struct("iou", (-F.col("right_id")).alias("r"))).alias("m"))
    out = first.select(page, key).join(best, [page, key], "left")
    return out.select(page, key, F.col("m").isNotNull().alias("confirmed"), (-F.col("m.r")).alias("match_id"), F.col("m.iou").alias("iou"))


def first_on_page(texts: DataFrame, items: DataFrame, page: str = "page", order: str = "id") -> DataFrame:
    """Each text with the first item of its page, if any: one aggregate and an outer join."""
    first = items.groupBy(page).agg(F.min(order).alias("item_id"))
    return texts.join(first, page, "left")


def completeness(cells: DataFrame, table: str = "table_id", cell: str = "cell") -> DataFrame:
    """Share of cells that hold something."""
    full = (F.coalesce(F.trim(cell), F.lit("")) != "").cast("double")
    return cells.groupBy(table).agg(F.avg(full).alias("completeness"))


def accuracy_part(accuracy: Column, odd_numbers: Column) -> Column:
    part = F.least(F.greatest(accuracy / 100.0, F.lit(0.0)), F.lit(1.0))
    return F.when(odd_numbers, part * 0.8).otherwise(part)


def consistency(header: Column, rows: Column) -> Column:
    """1 if every row is as wide as the header, else 0; without rows 0."""
    return F.when((F.size(rows) > 0) & F.forall(rows, lambda r: F.size(r) == F.size(header)), 1.0).otherwise(0.0)


def odd_numbers(header: Column, rows: Column) -> Column:
    """Whether a column that is mostly numbers holds a cell that is none (blank cells aside)."""
    cells = lambda j: F.filter(F.transform(rows, lambda r: cell_kind(F.get(r, j))), lambda k: k != EMPTY)
    numbers = lambda ks: F.size(F.filter(ks, lambda k: k.isin(WHOLE, NUMBER)))
    return F.exists(F.sequence(F.lit(0), F.greatest(F.size(header) - 1, F.lit(0))), lambda j: (numbers(cells(j)) < F.size(cells(j))) & (2 * numbers(cells(j)) > F.size(cells(j))))


def quality(tables: DataFrame, header: str = "header", rows: str = "cells", accuracy: str = "accuracy") -> DataFrame:
    """Tables with their parts (accuracy_part, completeness, consistency) and the weighted ``quality``."""
    h, r = F.col(header), F.col(rows)
    all_cells = F.flatten(r)
    full = F.size(F.filter(all_cells, lambda c: F.coalesce(F.trim(c), F.lit("")) != "")) / F.greatest(F.size(all_cells), F.lit(1))
    parts = tables.withColumns({"accuracy_part": accuracy_part(F.col(accuracy), odd_numbers(h, r)), "completeness": full, "consistency": consistency(h, r)})
    return parts.withColumn("quality", 0.4 * F.col("accuracy_part") + 0.3 * F.col("completeness") + 0.3 * F.col("consistency"))


def whitespace_part(whitespace: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - whitespace / 100.0)


def confidence(accuracy: Column, complete: Column, consistency: Column, whitespace: Column) -> Column:
    """A table's confidence from 0 to 100."""
    score = (0.4 * accuracy + 0.3 * complete + 0.1 * consistency + 0.2 * whitespace) * 100.0
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))


def best_parameters(results: DataFrame, page: str = "page", params: str = "params", quality: str = "quality", order: str = "trial") -> DataFrame:
    """For each page the parameters with the best mean quality; the first tried wins a tie."""
    mean = results.groupBy(page, params).agg(F.avg(quality).alias("mean_quality"), F.min(order).alias("first"))
    pick = F.struct(F.col("mean_quality"), (-F.col("first")).alias("first"), F.col(params).alias("params"))
    return mean.groupBy(page).agg(F.max(pick).alias("x")).select(page, F.col("x.params").alias(params), F.col("x.mean_quality").alias("mean_quality"))


def by_success(grid: DataFrame, counts: DataFrame, params: str = "params") -> DataFrame:
    """A parameter grid with those first that succeeded most often."""
    return grid.join(counts, params, "left").withColumn("successes", F.coalesce("successes", F.lit(0))).orderBy(F.col("successes").desc(), params)


def best_flavour(lattice: DataFrame, stream: DataFrame, least: float = 80.0, key: str = "id") -> DataFrame:
    """Of two readings of a table: the second only where the first is poor and the second better."""
    s = stream.select(key, F.col("accuracy").alias("_accuracy"), F.col("data").alias("_data"))
    better = (F.col("accuracy") < least) & (F.col("_accuracy") > F.col("accuracy"))
    joined = lattice.join(s, key, "left").withColumn("_b", F.coalesce(better, F.lit(False)))
    return joined.select(key, F.when(F.col("_b"), F.col("_data")).otherwise(F.col("data")).alias("data"), F.when(F.col("_b"), F.col("_accuracy")).otherwise(F.col("accuracy")).alias("accuracy"), F.when(F.col("_b"), "stream").otherwise("lattice").alias("flavour"))


def issues(tables: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Tables with what speaks against each."""
    found = F.filter(F.array(F.when(F.col("accuracy") < threshold, "low accuracy"), F.when(F.col("rows") < 2, "too few rows"), F.when(F.col("cols") < 2, "too few columns")), lambda x: x.isNotNull())
    return tables.withColumn("issues", found).withColumn("accepted", F.size("issues") == 0)


def merge_adjacent(tables: DataFrame, doc: str = "doc_id", order: str = "table_id", ratio: float = 0.5, continues: str | None = None) -> DataFrame:
    """Neighbouring tables of a document that continue one another, joined greedily in pairs.

    A pair fits when columns are equal, row counts are like (or one is a lone header) and the
    second follows on the same or the next page, or where the column ``continues`` says so; both are passed over after a merge.  In a run of
    fitting neighbours the greedy rule takes every second one, so the place in the run decides
    and no fold is needed.
    """
    w = Window.partitionBy(doc).orderBy(order)
    nxt = lambda c: F.lead(c).over(w)
    close = F.abs(F.col("rows") - nxt("rows")) / F.greatest(F.col("rows"), nxt("rows"))
    fits = F.col(continues) if continues else (F.col("columns") == nxt("columns")) & ((close <= ratio) | (F.col("rows") == 1) | (nxt("rows") == 1)) & (nxt("page") - F.col("page")).between(0, 1)
    marked = tables.select(F.col(doc).alias("doc_id"), F.col(order).alias("table_id"), "rows", "page", F.coalesce(fits, F.lit(False)).alias("fits"), F.row_number().over(w).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("n")
    broken = F.max(F.when(~F.col("fits"), F.col("n"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("head", F.col("fits") & ((F.col("n") - F.coalesce(broken, F.lit(0))) % 2 == 1))
    either = lambda c, other: F.when(F.col("head"), other).otherwise(c)
    out = marked.select(
        "doc_id",
        "table_id",
        either(F.array("table_id"), F.array(F.col("table_id"), nxt_of("table_id", w))).alias("merged"),
        either(F.col("rows"), F.col("rows") + nxt_of("rows", w)).alias("rows"),
        F.col("page").alias("first_page"),
        either(F.col("page"), nxt_of("page", w)).alias("last_page"),
        F.coalesce(F.lag("head").over(w), F.lit(False)).alias("taken"),
    )
    return out.where("not taken").drop("taken")


def nxt_of(column: str, w) -> Column:
    return F.lead(column).over(w)


def surrounding_text(blocks: DataFrame, doc: str, order: str, kind: str, content: str, reach: int = 3) -> DataFrame:
    """Tables with the text of up to ``reach`` blocks above and below."""
    from quillspark.functions.text import squeeze

    w = Window.partitionBy(doc).orderBy(order)
    text = F.when(F.col(kind) != "table", F.col(content))
    marked = blocks.withColumns({"above": F.collect_list(text).over(w.rowsBetween(-reach, -1)), "below": F.collect_list(text).over(w.rowsBetween(1, reach))})
    return marked.where(F.col(kind) == "table").select(doc, order, squeeze(F.array_join("above", " ")).alias("above"), squeeze(F.array_join("below", " ")).alias("below"))


def numbered(items: DataFrame, kind: str = "type", order: str = "ordinal", doc: str = "doc_id") -> DataFrame:
    """Elements with tables first and numbered anew."""
    w = Window.partitionBy(doc).orderBy(F.col(kind) != "table", order)
    return items.withColumn("element_id", F.row_number().over(w))


#: What a cell can be; a column's kind is the join of its cells' kinds, as bits that are or-ed.
EMPTY, WHOLE, NUMBER, TRUTH, TEXT = 0, 1, 2, 4, 8


def cell_kind(cell: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(cell, F.lit(""))))
    return (
        F.when(t == "", EMPTY)
        .when(t.rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+$|^[+-]?[0-9]+$"), WHOLE)
        .when(t.rlike(r"^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]*)\.?[0-9]+(e[+-]?[0-9]+)?%?$"), NUMBER)
        .when(t.isin("true", "false", "yes", "no"), TRUTH)
        .otherwise(TEXT)
    )


def column_kinds(rows: Column, width: Column) -> Column:
    """array<string>: each column's kind (empty, whole, number, truth, text) over all rows of a table; whole and number make
    number, truth with either of them text."""
    bits = lambda j: F.aggregate(rows, F.lit(0), lambda acc, r: acc.bitwiseOR(cell_kind(F.get(r, j))))
    name = lambda b: F.when(b == EMPTY, "empty").when(b == WHOLE, "whole").when(b < TRUTH, "number").when(b == TRUTH, "truth").otherwise("text")
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda j: name(bits(j)))).otherwise(F.array().cast("array<string>"))


def continuing(tables: DataFrame, texts: DataFrame, doc: str = "doc_id", order: str = "table_id", near_top: float = 50.0, near: float = 0.05, margin: float = 10.0) -> DataFrame:
    """Tables (doc, order, page, bbox, header, cells, content_top, content_bottom, margin_top, margin_bottom) with the mark
    ``continues``: the next table of the document goes on with this one.

    Headers and kinds of columns have to be equal (a lone first row may be a header: kinds and row counts are free then),
    no table may be empty, row counts within a half of the larger.  On another page the next table stands near its content's
    top, or this page's content goes beyond its lower margin and the next one's starts in its upper margin.  On one page
    no text stands between the two (``texts``: doc, page, bbox, content) and the gap is within ``near`` of the content's
    height, or there is no block at all between them.
    """
    rows = tables.withColumns({"rows": F.size("cells"), "kinds": column_kinds(F.col("cells"), F.size("header"))})
    # Tables and text blocks of a page in reading order: a running count of blocks gives what stands between two tables.
    y1, y2 = F.col("bbox.y1").cast("double"), F.col("bbox.y2").cast("double")
    marks = rows.select(F.col(doc).alias("_d"), F.col("page").alias("_p"), y1.alias("y"), F.lit(1).alias("_t"), F.col(order).alias("_o"), F.lit(0).alias("full"), F.lit(0).alias("any"))
    blank = (F.trim(F.coalesce("content", F.lit(""))) == "").cast("int")
    # A block counts from its upper edge on, less the margin by which it has to stand clear of the table above.
    marks = marks.unionByName(texts.select(F.col(doc).alias("_d"), F.col("page").alias("_p"), (y1 - margin).alias("y"), F.lit(0).alias("_t"), F.lit(None).cast(rows.schema[order].dataType).alias("_o"), (1 - blank).alias("full"), F.lit(1).alias("any")))
    w = Window.partitionBy("_d", "_p").orderBy("y", "_t", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = marks.withColumns({"full": F.sum("full").over(w), "any": F.sum("any").over(w)}).where("_t = 1").select("_d", "_p", "_o", "full", "any")
    rows = rows.join(before, (F.col(doc) == F.col("_d")) & (F.col("page") == F.col("_p")) & (F.col(order) == F.col("_o")), "left").drop("_d", "_p", "_o")
    w = Window.partitionBy(doc).orderBy(order)
    nxt = lambda c: F.lead(c).over(w)
    lone = F.col("rows") == 1
    share = F.abs(F.col("rows") - nxt("rows")) / F.greatest(F.col("rows"), nxt("rows"))
    like = (F.col("header") == nxt("header")) & (F.col("rows") > 0) & (nxt("rows") > 0) & (lone | ((F.col("kinds") == nxt("kinds")) & (share <= 0.5)))
    next_top = nxt(F.col("bbox.y1").cast("double"))
    across = (F.abs(next_top - nxt("content_top")) < near_top) | ((F.col("content_bottom") > F.col("margin_bottom")) & (nxt("content_top") < nxt("margin_top")))
    gap = F.abs(next_top - y2)
    along = (nxt("any") == F.col("any")) | ((nxt("full") == F.col("full")) & (gap < F.lit(near) * F.abs(F.col("content_bottom") - F.col("content_top"))))
    fits = like & F.when(F.col("page") == nxt("page"), along).otherwise(across)
    return rows.withColumn("continues", F.coalesce(fits, F.lit(False))).drop("full", "any")


def without_similar_text(texts: DataFrame, tables: DataFrame, least: float = 95.0, doc: str = "doc_id", page: str = "page", key: str = "block_id", text: str = "content", table_text: str = "table_text") -> DataFrame:
    """Text blocks less those that repeat a table of their page: normalised ratio of ``least`` or more.

    Such strings have lengths within a factor, so blocks and tables meet by page and class of length only.
    """
    gone = _repeats(texts, tables, least, doc, page, key, text, table_text)
    same = (F.col(doc) == F.col("_d")) & (F.col(page) == F.col("_p")) & (F.col(key) == F.col("_k"))
    return texts.join(gone, same, "left_anti")


def validated(elements: DataFrame, cache: DataFrame, least: float = 80.0, doc: str = "doc_id", page: str = "page", key: str = "block_id", text: str = "content", table_text: str = "table_text") -> DataFrame:
    """Elements with ``validated``: for tables, whether the cache has a table on that page that reads alike; else null."""
    found = _repeats(elements.where("type = 'table'"), cache, least, doc, page, key, text, table_text).withColumn("_yes", F.lit(True))
    same = (F.col(doc) == F.col("_d")) & (F.col(page) == F.col("_p")) & (F.col(key) == F.col("_k"))
    joined = elements.join(found, same, "left")
    return joined.select(*elements.columns, F.when(F.col("type") == "table", F.coalesce("_yes", F.lit(False))).alias("validated"))


def _repeats(texts: DataFrame, tables: DataFrame, least: float, doc: str, page: str, key: str, text: str, table_text: str) -> DataFrame:
    """(_d, _p, _k) of the texts that read like a table of their page."""
    from quillspark.functions.fuzzy import alike

    if not 0 < least <= 100:
        raise ValueError("least must be above 0, 100 at most")
    factor = max((200.0 - least) / least, 1.0001)
    cls = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1)).cast("double")) / F.lit(math.log(factor))).cast("int")
    a = texts.select(F.col(doc).alias("_d"), F.col(page).alias("_p"), F.col(key).alias("_k"), normal(F.col(text)).alias("_a")).where("_a <> ''")
    a = a.withColumn("_c", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: cls("_a") + i)))
    b = tables.select(F.col(doc).alias("_d"), F.col(page).alias("_p"), normal(F.col(table_text)).alias("_b")).where("_b <> ''").distinct().withColumn("_c", cls("_b"))
    return a.join(b, ["_d", "_p", "_c"]).where(alike(F.col("_a"), F.col("_b"), least).isNotNull()).select("_d", "_p", "_k").distinct()


def normal(text: Column) -> Column:
    """Lower case, white space runs as a blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


#: So many levels of nested JSON are made in one pass.
LEVELS = 8


def nodes(documents: DataFrame, key: str, json: str = "json", children: str = "children", most_depth: int = 1000) -> DataFrame:
    """(key, path, parent, depth, type, text) of the nodes of nested JSON, to any depth.

    The text is parsed to a variant once, and each level of children is one more ``posexplode`` in the same pass, which hands on
    the nodes above as they are.  How many levels there can be is told by their schemas, an aggregate of one row.
    Texts with more than eight levels go on from those that were reached, which are settled, so that neither plans nor
    recomputation grow with the depth.  ``path`` is the list of places from the top, ``parent`` the path above.  Malformed text
    has no nodes; nesting deeper than ``most_depth`` is an error.  (A recursive query would stop at a million rows.)
    """
    from quillspark.operators.lineage import settled

    top, most, depth = _parsed(documents.select(F.col(key).alias("k"), F.col(json).alias("j"))), min(LEVELS, most_depth), 0
    levels = nesting(F.col("v"), LEVELS)
    deepest = top.agg(F.max(levels)).first()[0] or 0
    found = [_below(top if deepest <= most else top.where(levels <= most), children, min(deepest, most))]
    if deepest > most:
        top = top.where(levels > most)
        while True:
            steps = min(LEVELS, most_depth + 1 - depth)
            reached, depth = _below(top, children, steps), depth + steps
            found.append(reached.where(F.size("path") < depth))
            top = settled(reached.where(F.size("path") == depth))
            if top.isEmpty():
                break
            if depth > most_depth:
                raise ValueError(f"nested deeper than {most_depth}")
    out = found[0]
    for rows in found[1:]:
        out = out.unionAll(rows)
    depth = F.size("path")
    parent = F.when(depth > 0, F.slice("path", F.lit(1), depth - 1))
    return out.select(F.col("k").alias(key), "path", parent.alias("parent"), depth.alias("depth"), *[F.coalesce(_string(c), F.col(c)).alias(c) for c in ("type", "text")])


def nesting(v: Column, most: int) -> Column:
    """How deep a variant's arrays are nested at most, by its schema; ``most`` + 1 where fields differ so that the schema hides some."""
    schema = F.schema_of_variant(v)
    return F.when(F.contains(schema, F.lit("VARIANT")), most + 1).otherwise(F.size(F.split(schema, "ARRAY<")) - 1)


def _parsed(texts: DataFrame) -> DataFrame:
    """The top nodes of texts, open: their variant isn't taken apart yet.  A generator keeps the text from being parsed twice."""
    v = F.explode(F.array(F.try_parse_json("j"))).alias("v")
    none = F.lit(None).cast("string")
    return texts.select("k", v).where("v is not null").select("k", F.array().cast("array<int>").alias("path"), "v", none.alias("type"), none.alias("text"))


def _string(name: str) -> Column:
    return F.expr(f"try_variant_get(v, '$.{name}', 'string')")


def _below(rows: DataFrame, children: str, steps: int) -> DataFrame:
    """The rows and so many levels below them; those of the last level stay open."""
    for _ in range(steps):
        # Place 0 is the node itself, closed: its strings are read and its variant goes.
        listed = f"coalesce(try_variant_get(v, '$.{children}', 'array<variant>'), array())"
        rows = rows.select("*", F.posexplode(F.expr(f"concat(array(cast(null as variant)), {listed})")).alias("at", "child"))
        own = lambda c: F.when(F.col("at") == 0, F.coalesce(F.col(c), _string(c))).alias(c)
        path = F.when(F.col("at") == 0, F.col("path")).otherwise(F.array_append("path", F.col("at") - 1))
        rows = rows.select("k", path.alias("path"), F.col("child").alias("v"), own("type"), own("text"))
    return rows


def fallback(*readings: Column) -> Column:
    """The first reading that found something."""
    return F.coalesce(*[F.when(F.size(r) > 0, r) for r in readings])
