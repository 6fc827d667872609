"""Streams with state of their own: job states that time out, and keys that pass once and never again.

Both need ``spark.sql.streaming.stateStore.providerClass`` to name the RocksDB provider (``use_rocksdb``), which keeps state on
disk and snapshots in the checkpoint folder: its size isn't bound by memory, and a restart goes on where it stopped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark.streaming.jobs import TRANSITIONS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOB = "job string, status string, start_time timestamp, end_time timestamp, message string"
FINAL = ("completed", "failed")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class JobMachine(StatefulProcessor):
    """One job's state: steps that TRANSITIONS allows are taken, others reported; a job silent for too long is failed.

    With event time a job times out when the watermark passes its last event by ``timeout_ms``, with processing time by the clock.
    """

    def __init__(self, timeout_ms: int, event_time: bool):
        self.timeout_ms, self.event_time = timeout_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, start_ms long, last_ms long")

    def handleInputRows(self, key, rows, timerValues):
        status, start, last = self.state.get() or ("", None, None)
        out = []
        # Of events at one time, those of one batch go by their steps' order: pending, running, then an end.
        batch = pd.concat(rows).sort_values(["ts", "tie"], kind="stable")
        for ts, to in zip(batch["ts"], batch["status"], strict=True):
            now = int(ts.timestamp() * 1000)
            if (status, to) not in TRANSITIONS:
                out.append((key[0], status or None, start, None, f"refused: {to}"))
                continue
            status, last = to, now
            start = now if to == "running" else None if to == "pending" else start
            out.append((key[0], status, start, now if to in FINAL else None, None))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if status not in ("", *FINAL):
            base = last if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(base + self.timeout_ms)
        if status:
            self.state.update((status, start, last))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        status, start, last = self.state.get()
        end = expiredTimerInfo.getExpiryTimeInMs()
        self.state.update(("failed", start, end))
        yield _frame([(key[0], "failed", start, end, "timed out")])

    def close(self) -> None:
        pass


def _frame(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["job", "status", "start_time", "end_time", "message"])
    for c in ("start_time", "end_time"):
        out[c] = pd.to_datetime(out[c].astype("Int64"), unit="ms")
    return out


def job_machine(events: DataFrame, timeout_ms: int, late: str | None = None) -> DataFrame:
    """A row for each step of each job of a stream (job, status, ts, tie): taken, refused, or failed for want of news.

    ``late`` turns event time on: the watermark, not the clock, decides what has timed out.
    """
    rows = events.selectExpr("cast(job as string) as job", "cast(status as string) as status", "ts", "cast(tie as long) as tie")
    rows = rows.withWatermark("ts", late) if late else rows
    machine = JobMachine(timeout_ms, late is not None)
    return rows.groupBy("job").transformWithStateInPandas(machine, outputStructType=JOB, outputMode="Update", timeMode="EventTime" if late else "ProcessingTime")


class FirstOnly(StatefulProcessor):
    """Lets a key's first row pass, for good: the mark has no time to live."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key, rows, timerValues):
        first = self.seen.exists()
        for frame in rows:
            if not first:
                first = True
                self.seen.update((True,))
                yield frame.head(1)

    def close(self) -> None:
        pass


def visited_once(stream: DataFrame, key: str) -> DataFrame:
    """Each key once in the whole life of the stream, restarts included; a state entry of a few bytes for each key."""
    return stream.groupBy(key).transformWithStateInPandas(FirstOnly(), outputStructType=stream.schema, outputMode="Append", timeMode="None")
