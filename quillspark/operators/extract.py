"""The extraction pipeline: a folder's files to typed blocks, with counters, and a search over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import html as hx, markdown as mx
from quillspark.operators.search import substring_search
from quillspark.sources import files

#: Globs of files that aren't documents.
EXCLUDED = ("*.lock", "*.min.js", "*.png", "*.jpg", "*.gif", "*.pdf", "*.zip", "node_modules/*", "*/node_modules/*", "__pycache__/*", "*/__pycache__/*")


def extract_folder(spark: SparkSession, folder: str, suffixes=None, exclude=EXCLUDED, most: int = 10 * 1024 * 1024, first_only: bool = False) -> tuple[DataFrame, Observation]:
    """Blocks of all files by their suffix, and an observation with the counts of files and bytes.

    The observation fills when the blocks are first computed.
    """
    metrics = Observation("extract")
    found = files.walk(spark, folder, suffixes, exclude, most).withColumn("text", files.decoded(F.col("content"))).drop("content")
    found = found.observe(metrics, F.count("*").alias("files"), F.sum("length").alias("bytes"))
    suffix = F.lower(F.regexp_extract("relative", r"\.([^./]+)$", 1))
    whole = F.when(F.trim("text") != "", F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("content"), F.lit(None).cast("string").alias("language"), F.lit("file").alias("block_type"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"))))
    blocks = F.when(suffix.isin("md", "mdx", "markdown"), mx.rows_udf(mx.markdown_blocks, mx.BLOCK)(F.col("text"))).when(suffix.isin("html", "htm"), mx.rows_udf(hx.html_blocks, mx.BLOCK)(F.col("text")))
    blocks = blocks.when(suffix == "rst", mx.rows_udf(mx.rst_content, mx.BLOCK)(F.col("text")))
    blocks = blocks.when(suffix == "ipynb", mx.rows_udf(mx.notebook_blocks, mx.BLOCK)(F.col("text"))).otherwise(whole)
    rows = found.select("relative", F.posexplode(blocks).alias("ordinal", "b")).select("relative", "ordinal", "b.*")
    return (rows.where("ordinal = 0") if first_only else rows), metrics


def search_blocks(blocks: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Blocks that contain the query, the shortest first."""
    return substring_search(blocks.withColumn("key", F.concat_ws("#", "relative", "ordinal")), query, "key", "content", limit)
