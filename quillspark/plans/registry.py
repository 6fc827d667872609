"""Registration of queries with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as knowledge-base entries: problem, solution, tags."""
    d = table(spark, sf_dir, "documents")
    at = F.locate("\n", F.col("text"))
    return d.select(
        "doc_id",
        "text",
        F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise(F.col("text")).alias("problem"),
        F.when(at > 0, F.expr("substring(text, locate('\n', text) + 1)")).otherwise(F.lit("")).alias("solution"),
        F.array("lang", "source").alias("tags"),
        "lang",
        "source",
        "n_chars",
    )


LESSONS = """lessons AS (
  SELECT doc_id, text, lang, source, n_chars, [lang, source] AS tags,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS problem,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS solution
  FROM documents)"""


def words_sql(column: str) -> str:
    return f"list_filter(string_split_regex(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
