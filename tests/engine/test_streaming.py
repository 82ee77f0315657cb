"""Streams over files that arrive one by one: late rows, restarts, state across batches."""

import datetime as dt

from skeinlake.streaming import stats

SCHEMA = "call_id long, tool string, duration_ms double, ok boolean, ts timestamp_ntz, service long"


def _drop(spark, folder, name, rows):
    spark.createDataFrame([(k, tool, 1.0, True, dt.datetime(2024, 1, 1, hour, minute), service) for k, tool, hour, minute, service in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def _read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


def test_windows_close_and_late_rows_are_dropped(spark, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "cp")
    def finish():
        q = stats.windowed_tool_stats(_read(spark, src)).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination()
    _drop(spark, src, "a", [(1, "t", 0, 10, 1), (2, "t", 0, 50, 1)])
    finish()
    _drop(spark, src, "b", [(3, "t", 9, 0, 1)])
    finish()
    _drop(spark, src, "c", [(4, "t", 0, 20, 1), (5, "t", 20, 0, 1)])
    finish()
    got = {(r["start"].hour, r["calls"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (0, 2) in got and (0, 3) not in got and (0, 1) not in got and (9, 1) in got


def test_status_changes_across_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for name, rows in (("a", [(1, "Up", 1, 0, 7), (2, "Down", 2, 0, 7)]), ("b", [(3, "Down", 3, 0, 7), (4, "Up", 4, 0, 7), (5, "Up", 4, 0, 8)])):
        _drop(spark, src, name, rows)
        events = _read(spark, src).selectExpr("call_id as event_id", "service", "tool as status", "ts")
        q = stats.status_changes(events).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(2, 7, "Down", "Up"), (4, 7, "Up", "Down")}


def test_appended_snapshots_are_written_once(spark, tmp_path):
    src, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    snapshots = lambda: _read(spark, src).selectExpr("tool as branch", "call_id", "ts")
    _drop(spark, src, "a", [(1, "main", 1, 0, 1)])
    stats.append_snapshots(snapshots(), out, at).awaitTermination()
    _drop(spark, src, "b", [(2, "dev", 2, 0, 1)])
    stats.append_snapshots(snapshots(), out, at).awaitTermination()
    stats.append_snapshots(snapshots(), out, at).awaitTermination()
    assert sorted(r["call_id"] for r in spark.read.json(out).collect()) == [1, 2]


def test_status_changes_over_frames(spark, tmp_path):
    """A service's rows come in several frames, later ones first in time."""
    src, n = str(tmp_path / "in"), 40
    _drop(spark, src, "a", [(k, "ab"[k // 2 % 2], k // 60, k % 60, service) for k in reversed(range(n)) for service in (7, 8)] + [(99, None, 1, 0, 8)])
    _drop(spark, src, "b", [(100, "a", 2, 0, 7), (101, "a", 2, 0, 8)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        events = _read(spark, src).selectExpr("call_id as event_id", "service", "tool as status", "ts")
        q = stats.status_changes(events).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = [(k, service, "ab"[k // 2 % 2], "ba"[k // 2 % 2]) for k in range(2, n, 2) for service in (7, 8)]
    assert got == sorted([*want, (100, 7, "a", "b")])
