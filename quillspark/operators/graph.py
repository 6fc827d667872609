"""Traversal by joining a frontier with the edges, one level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.lineage import settled
from quillspark.operators.search import check_parameters


def traverse(edges: DataFrame, starts: DataFrame, least: int = 1, most: int = 1, direction: str = "OUTBOUND", src: str = "src", dst: str = "dst", key: str = "edge_id", limit: int | None = None) -> DataFrame:
    """(start, vertex, edge, depth, path) of all paths with least..most edges.

    An edge is used once in a path, vertices may come again; depth 0 is the start itself.
    """
    check_parameters(direction=direction)
    if not 0 <= least <= most:
        raise ValueError("depths must be 0 <= least <= most")
    e = edges.select(F.col(key).alias("edge"), F.col(src).alias("a"), F.col(dst).alias("b"))
    if direction != "OUTBOUND":
        back = e.select("edge", F.col("b").alias("a"), F.col("a").alias("b"))
        e = back if direction == "INBOUND" else e.unionAll(back.where("a <> b"))
    first = starts.columns[0]
    empty = F.array().cast(f"array<{e.schema['edge'].dataType.simpleString()}>")
    level = starts.select(F.col(first).alias("start"), F.col(first).alias("vertex"), F.lit(None).cast(e.schema["edge"].dataType).alias("last"), empty.alias("path"))
    out = [level.withColumn("depth", F.lit(0))] if least == 0 else []
    for depth in range(1, most + 1):
        level = level.join(e, level["vertex"] == e["a"]).where(~F.array_contains("path", F.col("edge")))
        level = level.select("start", F.col("b").alias("vertex"), F.col("edge").alias("last"), F.array_append("path", F.col("edge")).alias("path"))
        level = settled(level) if depth < most else level
        if depth >= least:
            out.append(level.withColumn("depth", F.lit(depth)))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    rows = rows.select("start", "vertex", F.col("last").alias("edge"), "depth", "path")
    return rows.orderBy("start", "path").limit(limit) if limit is not None else rows


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, most: int, page: str = "url", src: str = "src", dst: str = "dst", status: str = "status") -> DataFrame:
    """(url, depth, status) breadth-first: each page once, at its least depth.

    Links are followed from pages whose status is success only; unknown pages fail.  Each level
    is computed once.
    """
    known = pages.select(F.col(page).alias("url"), F.col(status).alias("status"))
    visit = lambda urls, depth: urls.join(known, "url", "left").select("url", F.lit(depth).alias("depth"), F.coalesce("status", F.lit("failed_request")).alias("status"))
    visited = frontier = visit(seeds.select(F.col(seeds.columns[0]).alias("url")).distinct(), 0)
    for depth in range(1, most + 1):
        nxt = frontier.where("status = 'success'").join(links, F.col("url") == F.col(src)).select(F.col(dst).alias("url")).distinct()
        frontier = settled(visit(nxt.join(visited, "url", "left_anti"), depth))
        visited = visited.unionByName(frontier)
    return visited
