"""Connected components by alternating large-star and small-star contraction.

Every round is made of aggregates and joins on node ids, written to the shared folder, so no
component is ever gathered in one task or on the driver.  Rounds grow with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import Table


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.select("a", F.col("m").alias("b")).unionAll(rest).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is the smallest node.

    Self loops and null ends are dropped; an empty edge table gives an empty result.
    """
    e = edges.where(f"{u} <> {v}").select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).distinct()
    table = Table(e, "edges")
    mark = None
    while True:
        if table.df.isEmpty():
            break
        nxt = Table(_small_star(_large_star(table.df)), "stars")
        now = nxt.df.agg(F.count("*"), *[F.bit_xor(F.xxhash64(F.lit(i), "a", "b")) for i in (1, 2)]).first()
        table.drop()
        table = nxt
        if now == mark:
            break
        mark = now
    return table.df.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        table.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


