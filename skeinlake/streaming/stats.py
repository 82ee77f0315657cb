"""Operational aggregates over streams; each gives what its batch form gives over the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ops import tool_stats


def running_tool_stats(calls: DataFrame) -> DataFrame:
    """Statistics of each tool since the start; for the update or complete output mode. State is one row a tool."""
    return tool_stats(calls)


def windowed_tool_stats(calls: DataFrame, size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Calls and time by tool and window; a watermark bounds the state, and rows later than it are dropped."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(window.alias("w"), "tool").agg(F.count("*").alias("calls"), F.sum("duration_ms").alias("total_ms")).select("tool", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls", "total_ms")


def sessions(calls: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each service: calls no further apart than the gap."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "service").agg(F.count("*").alias("calls")).select("service", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def _changes(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Frames are cut at Arrow's batch size, in no order of time: a service's rows of a batch are sorted as one."""
    rows = pd.concat(frames).sort_values(["ts", "event_id"])
    before = rows["status"].shift()
    if state.exists:
        before.iloc[0] = state.get[0]
    changed = before.notna() & rows["status"].notna() & (before != rows["status"])
    last = rows["status"].iloc[-1]
    if last is not None:
        state.update((last,))
    elif state.exists:
        state.remove()
    yield pd.DataFrame({"event_id": rows["event_id"], "service": key[0], "status": rows["status"], "before": before})[changed]


def status_changes(events: DataFrame) -> DataFrame:
    """(event_id, service, status, before) whenever a service's status changes; state is the last status of each service. Within a batch events are ordered by time; across batches as they come. A task holds one service's rows of a batch at once."""
    return events.select("event_id", "service", "status", "ts").groupBy("service").applyInPandasWithState(_changes, "event_id long, service long, status string, before string", "last string", "append", "NoTimeout")


def append_snapshots(snapshots: DataFrame, folder: str, checkpoint: str):
    """Starts a query that appends snapshots to a folder by branch, each exactly once."""
    return snapshots.writeStream.outputMode("append").format("json").partitionBy("branch").option("checkpointLocation", checkpoint).option("path", folder).trigger(availableNow=True).start()
