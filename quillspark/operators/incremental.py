"""Extraction that goes on from the last run: only files whose content changed are taken apart again.

A manifest keeps the digest of each file; blocks are kept by their place (file and ordinal).  A run replaces the blocks of
changed files and removes those of files that are gone, in one snapshot of the block table; the manifest follows, so a run
that dies between the two is simply done again.  Vectors are computed for texts that no kept block has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.lineage import settled
from quillspark.operators.stored import StoredTable

MANIFEST = "relative string, digest string"
GONE = "_gone"


def refresh(files: DataFrame, manifest: StoredTable, blocks: StoredTable, extract, embed=None) -> dict[str, int]:
    """Bring the stored blocks in line with (relative, text) files; returns the numbers of files, changed and gone ones.

    ``extract`` maps changed files to rows (relative, ordinal, ..., content).  The block table has the key ``block_id``,
    ``section_id`` (the content's digest) and, if ``embed`` (Column to Column) is given, ``embedding``.
    """
    hashed = files.select("relative", F.sha2("text", 256).alias("digest")).dropDuplicates(["relative"])
    known = manifest.read().withColumnRenamed("digest", "_known")
    both = hashed.join(known, "relative", "full")
    state = settled(both.where("not (digest <=> _known)").select("relative", "digest"))
    changed = state.where("digest is not null").select("relative")
    counts = state.agg(F.count("digest").alias("changed"), F.sum(F.col("digest").isNull().cast("long")).alias("gone")).first()
    out = {"files": hashed.count(), "changed": counts["changed"], "gone": counts["gone"] or 0}
    if not out["changed"] + out["gone"]:
        return out
    old = blocks.read()
    new = extract(files.join(changed, "relative", "left_semi")).withColumns({"block_id": F.concat_ws("#", "relative", F.col("ordinal").cast("string")), "section_id": F.sha2("content", 256)})
    if embed is not None:
        vectors = old.groupBy("section_id").agg(F.first("embedding", True).alias("embedding"))
        new = settled(new)
        have = new.join(vectors, "section_id")
        want = new.join(vectors.select("section_id"), "section_id", "left_anti")
        made = want.select("section_id", "content").dropDuplicates(["section_id"]).select("section_id", embed(F.col("content")).alias("embedding"))
        new = have.unionByName(want.join(made, "section_id"))
    new = new.select(*old.columns).withColumn(GONE, F.lit(False))
    removed = old.join(state.select("relative"), "relative", "left_semi").select("block_id").withColumn(GONE, F.lit(True))
    removed = removed.join(new.select("block_id"), "block_id", "left_anti")
    changes = settled(new.unionByName(removed, allowMissingColumns=True))
    blocks.change(changes, replaced("block_id"))
    marks = state.withColumn(GONE, F.col("digest").isNull())
    manifest.change(marks, replaced("relative"))
    return out


def replaced(key: str):
    """The rows of a table after changes, of which those marked as gone only remove."""

    def how(rows: DataFrame, changes: DataFrame) -> DataFrame:
        return rows.join(changes.select(key), key, "left_anti").select(*rows.columns).unionByName(changes.where(~F.col(GONE)).select(*rows.columns))

    return how


def embedded_once(table: DataFrame, changes: DataFrame, key: str, search_fields, embed, vector: str = "embedding") -> DataFrame:
    """A partial update of stored rows whose vectors follow: rows of which a search field changes are embedded anew."""
    from quillspark.operators.store import update

    fields = [f for f in search_fields if f in changes.columns]
    text: Column = F.concat_ws("\n", *[F.nullif(F.trim(f), F.lit("")) for f in search_fields])
    before = table.select(F.col(key), *[F.col(f).alias(f"_old_{f}") for f in fields])
    after = update(table, changes, key).join(before, key)
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"_old_{f}"))
    kept = after.where(~differs)
    return kept.select(*table.columns).unionByName(after.where(differs).withColumn(vector, embed(text)).select(*table.columns))
