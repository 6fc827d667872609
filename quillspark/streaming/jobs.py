"""Streams: the index folder, first visits, job states, and event-time windows as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRANSITIONS = {("", "pending"), ("pending", "running"), ("running", "completed"), ("running", "failed"), ("completed", "pending"), ("failed", "pending")}


def first_visits(stream: DataFrame, key: str, time_col: str, late: str = "1 hour") -> DataFrame:
    """Each key once inside the watermark, which bounds the state; a key that comes again later than that passes again.

    Where a key must never return, ``sources.index.new_files`` tests against the stored index as well.
    """
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])


def job_states(events: DataFrame, job: str = "job", status: str = "status", time_col: str = "ts", tie: str = "event_id") -> DataFrame:
    """The current state of each job, in batch or (output mode update or complete) as a stream."""
    return events.groupBy(job).agg(F.max_by(F.col(status), F.struct(time_col, tie)).alias("status"), F.min(time_col).alias("start_time"), F.max(time_col).alias("last_time"), F.count("*").alias("n_events"))


def refused(events: DataFrame, job: str, status: str, time_col: str, tie: str) -> DataFrame:
    """Events whose step from the state before isn't allowed."""
    from pyspark.sql import Window

    w = Window.partitionBy(job).orderBy(time_col, tie)
    step = F.struct(F.coalesce(F.lag(status).over(w), F.lit("")).alias("a"), F.col(status).alias("b"))
    allowed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(TRANSITIONS)])
    return events.withColumn("_ok", F.array_contains(allowed, step)).where(~F.col("_ok")).drop("_ok")


def windowed(events: DataFrame, time_col: str = "ts", size: str = "1 hour", kind: str = "event_type", value: str = "value", late: str | None = None) -> DataFrame:
    """Extension beyond the reference: counts and sums in event-time windows."""
    rows = events.withWatermark(time_col, late) if late else events
    w = F.window(time_col, size)
    return rows.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to a JSONL index; the checkpoint makes each file's rows arrive once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
