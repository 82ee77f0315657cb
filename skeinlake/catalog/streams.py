"""Streaming forms, run to the end over the events table and held against their batch results."""

import os

from pyspark.sql import functions as F

from ..plans.tables import passing
from ..streaming import stats
from .registry import query


def _stream(i):
    """The events as a stream of files."""
    batch = i.table("events")
    path = f"{i.sf_dir}/events.parquet"
    folder, name = (path, None) if os.path.isdir(path) else (i.sf_dir, "events.parquet")
    reader = i.spark.readStream.schema(batch.schema)
    raw = (reader.option("pathGlobFilter", name) if name else reader).parquet(folder)
    return raw.select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"), F.col("value").alias("duration_ms"), ((F.col("event_type") != "error") & (F.col("event_id") % 7 != 0)).alias("ok"), "ts", F.col("user_id").alias("service"))


def _finish(df, i, mode):
    """Runs a stream over all that is there and gives its result as a table. Each batch is written to the shared folder under its number, so one that runs again replaces itself; in complete mode the last one holds all."""
    at, done = passing(i.spark, "stream"), []

    def keep(batch, k):
        batch.write.mode("overwrite").parquet(f"{at}/rows/{k}")
        done.append(k)

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return i.spark.read.schema(df.schema).parquet(f"{at}/rows/{max(done)}" if mode == "complete" else f"{at}/rows/*")


@query("st01_running_stats", "SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (WHERE event_type <> 'error' AND event_id % 7 <> 0) AS succeeded, round(sum(value), 6) AS total_ms FROM events GROUP BY 1")
def st01(i):
    return _finish(stats.running_tool_stats(_stream(i)), i, "complete").select("tool", "calls", "succeeded", F.round("total_ms", 6).alias("total_ms"))


@query("st02_windows", "SELECT event_type AS tool, date_trunc('hour', ts) AS start, count(*) AS calls, round(sum(value), 6) AS total_ms FROM events GROUP BY ALL")
def st02(i):
    return _finish(stats.windowed_tool_stats(_stream(i)), i, "complete").select("tool", F.col("start").cast("timestamp_ntz").alias("start"), "calls", F.round("total_ms", 6).alias("total_ms"))


@query("st03_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id AS service, min(ts) AS start, count(*) AS calls FROM s GROUP BY user_id, k")
def st03(i):
    return _finish(stats.sessions(_stream(i)), i, "complete").select("service", F.col("start").cast("timestamp_ntz").alias("start"), "calls")


@query("st06_status_changes", "SELECT event_id, user_id AS service, event_type AS status, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type")
def st06(i):
    return _finish(stats.status_changes(_stream(i).select(F.col("call_id").alias("event_id"), "service", F.col("tool").alias("status"), "ts")), i, "append")
