"""Files and documents as sources: folders, text decoding, JSON, notebooks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION_FOLDERS = (".git", ".hg", ".svn")


def walk(spark: SparkSession, folder: str, suffixes=None, exclude=(), most: int | None = None) -> DataFrame:
    """(path, relative, length, content) of a folder's files.

    Folders of version control are left out, as are relative paths that match an exclude glob;
    files over ``most`` bytes are left out by the source's own length column.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    base = re.sub("^file:/+", "/", folder).rstrip("/") + "/"
    files = files.withColumn("relative", F.expr(f"substring(path, {len(base) + 1})"))
    files = files.where(~F.col("relative").rlike("(^|/)(" + "|".join(re.escape(x) for x in VERSION_FOLDERS) + ")/"))
    if suffixes:
        files = files.where(F.lower(F.regexp_extract("relative", r"(\.[^./]+)$", 1)).isin([s.lower() for s in suffixes]))
    for glob in exclude:
        files = files.where(~F.col("relative").rlike(glob_pattern(glob)))
    if most is not None:
        files = files.where(F.col("length").between(0, most))
    return files.select("path", "relative", "length", "content")


def glob_pattern(glob: str) -> str:
    """A file glob as a pattern for the whole path; * also crosses folders."""
    out = "".join(".*" if c == "*" else "." if c == "?" else c if c in "[]" else re.escape(c) for c in glob)
    return f"^{out}$"


def decoded(content: Column) -> Column:
    """UTF-8 without its mark, else Latin-1 (which accepts any bytes)."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def seed(spark: SparkSession, path: str, field: str, item: str) -> DataFrame:
    """Rows of a JSON file {"field": [item, ...]}."""
    return read_json(spark, path, f"`{field}` array<struct<{item}>>").select(F.explode(field).alias("x")).select("x.*")


CELLS = "cells array<struct<cell_type:string,source:array<string>>>"


def notebook_cells(notebook: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, code, description): code cells with the markdown cell just before each."""
    cell = notebook.select(key, F.posexplode("cells").alias("ordinal", "cell"))
    rows = cell.select(key, "ordinal", F.col("cell.cell_type").alias("kind"), F.array_join("cell.source", "").alias("source"))
    return preceding(rows, key, "ordinal", "kind", "source", "markdown", "code")


def preceding(rows: DataFrame, key: str, order: str, kind: str, content: str, before: str, after: str) -> DataFrame:
    """Rows of one kind with the content of the row before, where that is of another kind."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumns({"_kind": F.lag(kind).over(w), "_content": F.lag(content).over(w)})
    out = marked.where((F.col(kind) == after) & (F.trim(content) != ""))
    return out.select(key, order, F.col(content).alias("code"), F.when(F.col("_kind") == before, F.col("_content")).otherwise(F.lit("")).alias("description"), F.sha2(content, 256).alias("section_id"))


def total_size(files: DataFrame, most: int) -> DataFrame:
    """(bytes, fits) of a download."""
    return files.agg(F.sum("length").alias("bytes")).select(F.coalesce("bytes", F.lit(0)).alias("bytes"), (F.coalesce("bytes", F.lit(0)) <= most).alias("fits"))


def save_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
