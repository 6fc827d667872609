"""Changes to keyed tables as pure DataFrame functions: each returns the table's next state."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.lineage import settled

BASE_EDGE_FIELDS = ("_key", "_from", "_to", "rationale", "type", "timestamp")
IMMUTABLE = ("_key", "_id", "_rev")


def now() -> Column:
    """The time of the change as a constant; a time taken in the plan would move on every read."""
    return F.lit(datetime.now(timezone.utc))


def get(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the last row by ``order``, then by the other columns: a partial aggregate, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c not in (key, order)]
    if any(kind in rows.schema[c].dataType.simpleString() for c in rest for kind in ("map<", "variant")):  # these have no order
        w = Window.partitionBy(key).orderBy(F.col(order).desc(), *[F.to_json(F.struct(c)).desc() for c in rest])
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    last = F.max(F.struct(F.col(order), *rest)).alias("_last")
    return rows.groupBy(key).agg(last).select(key, "_last.*").select(*rows.columns)


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Insert or replace: a key's changed row wins, of several the last by ``order``."""
    if order is not None:
        changes = last_of(changes, key, order)
    kept = table.join(changes.select(key).distinct(), key, "left_anti")
    return kept.select(*table.columns).unionByName(changes.select(*table.columns))


def update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Set the fields that a change gives (not null); other fields and rows stay."""
    fields = [c for c in changes.columns if c != key]
    c = changes.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = table.join(c, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{f}"), F.col(f)).alias(f) if f in fields else F.col(f) for f in table.columns])


def insert(table: DataFrame, rows: DataFrame, required=("problem", "solution"), key: str = "_key", time_col: str = "timestamp") -> DataFrame:
    """Append rows that have all required fields; a missing key or time is made, once, and then stays.

    Made keys are random, so rows are settled before they are appended.
    """
    test = [(F.coalesce(F.trim(F.col(r)), F.lit("")) != "") for r in required]
    good = rows.where(test[0] if len(test) == 1 else test[0] & test[1] if len(test) == 2 else F.expr(" and ".join(f"coalesce(trim(`{r}`), '') <> ''" for r in required)))
    made = {}
    if key in rows.columns:
        made[key] = F.coalesce(F.col(key).cast("string"), F.expr("uuid()"))
    if time_col in rows.columns:
        made[time_col] = F.coalesce(F.col(time_col), now())
    rows = good.withColumns(made)
    return table.unionByName(settled(rows) if key in made else rows, allowMissingColumns=True)


def insert_checked(table: DataFrame, rows: DataFrame, required=("role", "problem", "solution"), tags: str = "tags", **how) -> DataFrame:
    """``insert`` that refuses a table without the required fields, or whose tags aren't a list of strings."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing required fields: {missing}")
    if tags in rows.columns and rows.schema[tags].dataType.simpleString() != "array<string>":
        raise ValueError(f"{tags} must be a list of strings")
    return insert(table, rows, required, **how)


def first_rows(table: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key: a partial top n in each partition."""
    return table.orderBy(key).limit(n)


def among(rows: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Rows whose key is one of the candidates'."""
    return rows.join(candidates.select(key), key, "left_semi")


def first_records(index: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the first record by ``order``: one aggregate."""
    rest = [c for c in index.columns if c != key]
    return index.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_r")).select(key, "_r.*")


def merge_attributes(old: Column, new: Column) -> Column:
    """New attributes over old ones; a null removes one, and immutable ones can't change."""
    allowed = F.map_filter(new, lambda k, v: ~k.isin(*IMMUTABLE))
    gone = F.map_keys(allowed)
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(gone, k))
    return F.map_concat(kept, F.map_filter(allowed, lambda k, v: v.isNotNull()))


def merge(table: DataFrame, changes: DataFrame, key: str, attrs: str = "attrs", time_col: str | None = None) -> DataFrame:
    """Merge attribute maps by key."""
    c = changes.select(key, F.col(attrs).alias("_changes"))
    joined = table.join(c, key, "left")
    out = joined.withColumn(attrs, F.when(F.col("_changes").isNull(), F.col(attrs)).otherwise(merge_attributes(F.col(attrs), F.col("_changes"))))
    if time_col:
        out = out.withColumn(time_col, F.when(F.col("_changes").isNull(), F.col(time_col)).otherwise(now()))
    return out.select(*table.columns)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed; keys that don't exist change nothing."""
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def cascade(edges: DataFrame, keys: DataFrame, key: str, src: str = "_from", dst: str = "_to") -> DataFrame:
    """Edges that touch none of the keys at either end."""
    gone = keys.select(F.col(key).alias("_gone")).distinct()
    out = edges.join(gone, F.col(src) == F.col("_gone"), "left_anti")
    return out.join(gone, F.col(dst) == F.col("_gone"), "left_anti").select(*edges.columns)


def edge_attributes(attrs: Column, base: dict[str, Column]) -> Column:
    """Free attributes beside the base ones, which they can't override."""
    free = F.map_filter(attrs, lambda k, v: ~k.isin(*BASE_EDGE_FIELDS))
    pairs = [x for k, v in base.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_concat(free, F.create_map(*pairs))


def insert_edges(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Append edges with a rationale and a type."""
    good = rows.where("coalesce(trim(rationale), '') <> '' and coalesce(trim(type), '') <> ''")
    return edges.unionByName(good.select(*edges.columns))


def seed_edge(edges: DataFrame, vertices: DataFrame, edge: DataFrame, key: str = "_key") -> DataFrame:
    """Append an edge if both its vertices exist."""
    v = vertices.select(F.col(key).alias("_v"))
    ok = edge.join(v, F.col("_from") == F.col("_v"), "left_semi").join(v, F.col("_to") == F.col("_v"), "left_semi")
    return edges.unionByName(ok.select(*edges.columns))


def truncate(table: DataFrame, confirmed: bool) -> DataFrame:
    """The empty table; without confirmation nothing is done."""
    if not confirmed:
        raise ValueError("truncating needs a confirmation")
    return table.limit(0)


def latest(events: DataFrame, key: str, time_col: str, value: str, tie: str) -> DataFrame:
    """The last value of each key: a partial aggregate, no sort."""
    last = F.max_by(F.col(value), F.struct(time_col, tie))
    return events.groupBy(key).agg(last.alias(value), F.min(time_col).alias("started"), F.max(time_col).alias("ended"))


class Catalog:
    """Collections, edges and their graph by name, in the session's catalog of views; idempotent."""

    def __init__(self, spark):
        self.spark, self.kinds, self.graphs = spark, {}, {}

    def ensure(self, name: str, schema: str, kind: str = "document") -> DataFrame:
        if self.kinds.setdefault(name, kind) != kind:
            raise TypeError(f"{name} is no {kind} collection")
        if not self.spark.catalog.tableExists(name):
            self.spark.createDataFrame([], schema).createOrReplaceTempView(name)
        return self.spark.table(name)

    def graph(self, name: str, vertices: str, edges: str) -> tuple[str, str]:
        if self.kinds.get(edges) != "edge" or vertices not in self.kinds:
            raise TypeError("a graph needs a vertex and an edge collection")
        return self.graphs.setdefault(name, (vertices, edges))

    def postings(self, name: str, docs: DataFrame, key: str, fields) -> DataFrame:
        """An inverted index (key, field, term, tf) as a view."""
        from quillspark.functions import text as tx

        parts = [docs.select(key, F.lit(f).alias("field"), F.explode(tx.tokens(F.col(f))).alias("term")) for f in fields]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionAll(p)
        index = rows.groupBy(key, "field", "term").agg(F.count("*").alias("tf"))
        index.createOrReplaceTempView(name)
        return index
