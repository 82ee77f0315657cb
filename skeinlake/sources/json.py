"""JSON of scanners, snapshots, issues and models as tables, and the writers of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCANNER = "results array<struct<check_id:string,path:string,severity:string,lines:string,start:struct<line:bigint,col:bigint>,extra:struct<message:string,fix:string,severity:string>>>"
#: Writers keep microseconds, which the default format drops.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
SNAPSHOT = "branch string, ts timestamp_ntz, commit_hash string, debt double, complexity double, lines_of_code bigint, tags array<string>"


def scanner_findings(reports: DataFrame, body: str = "body", faithful: bool = False) -> DataFrame:
    """A row for each finding of JSON reports; what stands before the first brace is dropped, missing fields get defaults, malformed reports give none."""
    start = F.instr(body, "{")
    parsed = reports.withColumn("_r", F.from_json(F.when(start > 0, F.expr(f"substr({body}, instr({body}, '{{'))")), SCANNER))
    rows = parsed.select(*[c for c in reports.columns if c != body], F.posexplode("_r.results").alias("place", "f"))
    severity = F.col("f.severity") if faithful else F.coalesce("f.severity", "f.extra.severity")
    return rows.select(*[c for c in reports.columns if c != body], "place", F.coalesce("f.check_id", F.lit("unknown")).alias("rule"), F.coalesce("f.path", F.lit("")).alias("path"), F.coalesce("f.start.line", F.lit(0)).cast("long").alias("line"), F.coalesce(severity, F.lit("WARNING")).alias("severity"), F.coalesce("f.extra.message", F.lit("")).alias("message"), F.col("f.extra.fix").alias("fix"))


def parse_snapshots(lines: DataFrame) -> DataFrame:
    """Snapshots of JSON lines (branch, line); lines that don't parse are skipped."""
    return lines.select("branch", F.from_json("line", "day string, n bigint, avg double", {"mode": "PERMISSIVE"}).alias("s")).where("s.day is not null").select("branch", "s.day", "s.n", "s.avg")


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """All branches' snapshot files, snapshots_<branch>.jsonl, the branch taken from the file's name; bad lines are skipped."""
    df = spark.read.schema(f"{SNAPSHOT}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(f"{folder}/snapshots_*.jsonl")
    named = df.withColumn("branch", F.coalesce("branch", branch_of(F.input_file_name())))
    return named.where("_bad is null and ts is not null").drop("_bad")


def branch_of(path: Column) -> Column:
    """The branch that a snapshot file's name tells; empty if it isn't one."""
    return F.regexp_extract(path, r"snapshots_([^/]+)\.jsonl$", 1)


def safe_branch(branch: Column) -> Column:
    """A branch name as part of a file name."""
    return F.translate(branch, "/\\:", "___")


def append_snapshots(snapshots: DataFrame, folder: str) -> None:
    """Appends to one JSON-lines folder for each branch."""
    snapshots.withColumn("safe", safe_branch(F.col("branch"))).write.mode("append").option("timestampNTZFormat", MICROS).partitionBy("safe").json(folder)


def overwrite_branches(snapshots: DataFrame, folder: str) -> None:
    """Replaces the files of the branches that are given, and no other's."""
    snapshots.withColumn("safe", safe_branch(F.col("branch"))).write.mode("overwrite").option("timestampNTZFormat", MICROS).option("partitionOverwriteMode", "dynamic").partitionBy("safe").json(folder)


def read_appended(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{SNAPSHOT}, safe string").json(folder).drop("safe")


def csv_columns(snapshots: DataFrame) -> DataFrame:
    """Snapshots as CSV shows them: text, floats of two places."""
    two = lambda c: F.format_string("%.2f", F.col(c).cast("double")).alias(c)
    return snapshots.select("branch", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "commit_hash", F.col("lines_of_code").cast("string").alias("lines_of_code"), two("debt"), two("complexity"), two("stability"), two("coupling"))


def export_csv(snapshots: DataFrame, folder: str) -> None:
    csv_columns(snapshots).write.mode("overwrite").option("header", True).csv(folder)


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    """Rows as one JSON text each."""
    return df.select(F.to_json(F.struct(*columns)).alias("json"))


def issues(raw: DataFrame) -> DataFrame:
    """(id, title, state, labels, created) of issue JSON of two platforms; rows without an id are skipped."""
    get = lambda *paths: F.coalesce(*[F.get_json_object("body", p) for p in paths])
    millis = get("$.createdAt").try_cast("bigint")
    return raw.select(get("$.iid", "$.code").alias("id"), get("$.title", "$.name").alias("title"), get("$.state", "$.issueStatusName").alias("state"), F.coalesce(F.from_json(get("$.labels"), "array<string>"), F.array().cast("array<string>")).alias("labels"), (F.timestamp_millis(millis)).cast("timestamp_ntz").alias("created")).where("id is not null")


def model_content(body: Column) -> Column:
    """The text of a language model's response: the first of four shapes that has one."""
    return F.coalesce(F.get_json_object(body, "$.message.content"), F.get_json_object(body, "$.choices[0].message.content"), F.get_json_object(body, "$.response"), F.get_json_object(body, "$.content"))
