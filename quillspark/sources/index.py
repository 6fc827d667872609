"""The index of fetched files: its schema, scans with admission rules, and appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import urls
from quillspark.functions.jsontext import json_like

STATUSES = ("success", "failed_request", "failed_robotstxt", "failed_paywall", "failed_internal", "failed_precheck", "failed_ssrf", "failed_setup", "skipped", "skipped_domain", "failed_generic")
SCHEMA = "original_url string, canonical_url string, local_path string, content_md5 string, fetch_status string, http_status int, error_message string"
MOST_BYTES = 10 * 1024 * 1024


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a JSONL index; ``_corrupt_record`` holds lines that don't parse."""
    return spark.read.schema(SCHEMA + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def stream_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index folder as a stream; every new file is read once."""
    return spark.readStream.schema(SCHEMA).json(folder)


def searchable(index: DataFrame, base: str | None = None) -> DataFrame:
    """Valid, successful records with a searchable file under the base, first record of a path only."""
    ok = index.where(F.col("fetch_status").isin(*STATUSES) & (F.col("fetch_status") == "success") & (F.coalesce("local_path", F.lit("")) != ""))
    if "_corrupt_record" in index.columns:
        ok = ok.where("_corrupt_record is null").drop("_corrupt_record")
    ok = ok.where(urls.has_suffix(F.col("local_path")))
    return ok if base is None else ok.where(urls.inside(F.col("local_path"), base))


def scan_report(index: DataFrame) -> DataFrame:
    """Lines by what becomes of them."""
    kind = (
        F.when(F.col("_corrupt_record").isNotNull(), "malformed")
        .when(~F.coalesce(F.col("fetch_status").isin(*STATUSES), F.lit(False)), "invalid")
        .when((F.col("fetch_status") != "success") | (F.coalesce("local_path", F.lit("")) == ""), "not saved")
        .when(~urls.has_suffix(F.col("local_path")), "not searchable")
        .otherwise("searchable")
    )
    return index.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def records(pages: DataFrame, url: str = "url", content: str = "html", status: str = "fetch_status") -> DataFrame:
    """Index records of fetched pages."""
    c = urls.canonical(F.col(url))
    return pages.select(
        F.col(url).alias("original_url"),
        c.alias("canonical_url"),
        F.when(F.col(status) == "success", urls.local_path(F.col(url))).otherwise(F.lit("")).alias("local_path"),
        F.when(F.col(status) == "success", F.md5(content)).alias("content_md5"),
        F.when(F.col(status).isin(*STATUSES), F.col(status)).otherwise("failed_request").alias("fetch_status"),
        F.lit(None).cast("int").alias("http_status"),
        F.lit(None).cast("string").alias("error_message"),
    )


def git_records(files: DataFrame, repo: str, base: str) -> DataFrame:
    """Index records of a local checkout: (path, content) rows."""
    relative = F.regexp_replace("path", "^" + base.rstrip("/").replace(".", r"\.") + "/", "")
    return files.select(
        F.concat(F.lit(f"git:{repo}:"), relative).alias("original_url"),
        F.concat(F.lit("file://"), F.col("path")).alias("canonical_url"),
        relative.alias("local_path"),
        F.md5("content").alias("content_md5"),
        F.lit("success").alias("fetch_status"),
        F.lit(None).cast("int").alias("http_status"),
        F.lit(None).cast("string").alias("error_message"),
    )


def append_index(records_: DataFrame, path: str) -> None:
    """Append to a JSONL index; nulls are left out."""
    records_.write.mode("append").option("ignoreNullFields", "true").json(path)


def new_files(candidates: DataFrame, existing: DataFrame, path: str = "local_path", force: bool = False) -> DataFrame:
    """Candidates with a ``write`` mark: those that exist are skipped unless forced."""
    have = existing.select(F.col(path).alias("_have")).distinct().withColumn("_there", F.lit(True))
    marked = candidates.join(have, F.col(path) == F.col("_have"), "left")
    return marked.withColumn("write", F.lit(force) | F.col("_there").isNull()).drop("_have", "_there")


def example_index(blocks: DataFrame, content: str = "content") -> DataFrame:
    """JSON blocks that parse, as rows of an example index."""
    return blocks.where((F.col("type") == "json") & json_like(F.col(content)))


def write_examples(blocks: DataFrame, path: str, content: str = "content") -> int:
    """Write the example index as JSONL, nulls left out, and return its number of rows."""
    seen = Observation("examples")
    rows = example_index(blocks, content).observe(seen, F.count("*").alias("n"))
    rows.write.mode("overwrite").option("ignoreNullFields", "true").json(path)
    return seen.get["n"]
