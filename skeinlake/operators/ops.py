"""Operational aggregates, service registry and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tool_stats(calls: DataFrame, by: str = "tool") -> DataFrame:
    """Calls, successes, failures and durations of each tool."""
    d = F.col("duration_ms")
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.sum(d).alias("total_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"), F.avg(d).alias("avg_ms"))


def totals(calls: DataFrame) -> DataFrame:
    """The same over all tools, the average 0 without calls."""
    return calls.agg(F.count("*").alias("calls"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("duration_ms") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("avg_ms"))


def by_tool(services: DataFrame, tool: str) -> DataFrame:
    """Services that offer a tool, by membership in their list."""
    return services.where(F.array_contains("tools", tool))


def version(text: Column) -> Column:
    """A version as a struct, whose order is that of its parts; null if it isn't three numbers."""
    part = lambda k: F.regexp_extract(text, r"^\D*(\d+)\.(\d+)\.(\d+)$", k).try_cast("int")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def compatible(have: Column, want: Column) -> Column:
    """Same major version and not older."""
    return (have["major"] == want["major"]) & (have >= want)


def unmet_dependencies(services: DataFrame, requirements: DataFrame) -> DataFrame:
    """(service, needs, problem) of required dependencies that are missing, too old or not up."""
    have = services.select(F.col("service").alias("_s"), version(F.col("version")).alias("_v"), F.col("status").alias("_status"))
    joined = requirements.where("not optional").join(have, F.col("needs") == F.col("_s"), "left")
    problem = F.when(F.col("_s").isNull(), "missing").when(F.col("_v") < version(F.col("wanted")), "version").when(F.col("_status") != "Up", "not up")
    return joined.select("service", "needs", problem.alias("problem")).where("problem is not null")


def required_dependents(services: DataFrame, requirements: DataFrame) -> DataFrame:
    """Services that can't be removed, as others require them."""
    return services.join(requirements.where("not optional").select(F.col("needs").alias("service")), "service", "left_semi")


def dependency_edges(services: DataFrame, requirements: DataFrame) -> DataFrame:
    """Edges between services that are both there."""
    names = services.select("service")
    return requirements.join(names.withColumnRenamed("service", "needs"), "needs").join(names, "service").select(F.col("service").alias("src"), F.col("needs").alias("dst"))


def status_changes(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Events at which a key's status differs from the one before; a first event isn't a change."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("before", before).where(F.col("before") != F.col(status))


def cache_keys(texts: DataFrame, content: str, language: str) -> DataFrame:
    """(key, language, n): one row for each distinct content and language, the work that a cache leaves."""
    return texts.groupBy(F.md5(F.col(content)).alias("key"), F.col(language).alias("language")).agg(F.count("*").alias("n"))


def hit_rate(texts: DataFrame, content: str, language: str) -> DataFrame:
    """Hits, misses and their rate if texts arrive one by one at an empty, unbounded cache; 0 without texts."""
    return cache_keys(texts, content, language).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("hits"), F.count("*").alias("misses"), F.coalesce(F.try_divide(F.sum(F.col("n") - 1), F.sum("n")), F.lit(0.0)).cast("double").alias("hit_rate"))


def fresh_entries(entries: DataFrame, now: Column, seconds: int, keep: int | None = None) -> DataFrame:
    """Cache entries not older than a time to live, the newest so many if bounded."""
    out = entries.where(F.col("created") >= now - F.make_dt_interval(secs=F.lit(seconds)))
    return out if keep is None else out.orderBy(F.desc("created"), F.desc("key")).limit(keep)


def canonical_key(df: DataFrame, columns: list[str]) -> Column:
    """MD5 of the columns as JSON, in the order of their names."""
    return F.md5(F.to_json(F.struct(*sorted(columns))))


def refresh_due(resources: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Resources never refreshed, or longer ago than the interval."""
    return resources.where(F.col("refreshed").isNull() | (now - F.make_dt_interval(secs=F.lit(seconds)) > F.col("refreshed")))


def retries(failures: DataFrame, at: str, attempts: int = 3) -> DataFrame:
    """Each failure with its further attempts: the wait before each doubles from one second, and they follow one another."""
    every = failures.select("*", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt"))
    seconds = lambda k: F.pow(F.lit(2), k).cast("long")
    return every.withColumn("wait_seconds", seconds(F.col("attempt") - 1)).withColumn("at", (F.col(at) + F.make_interval(secs=seconds(F.col("attempt")) - 1)).cast("timestamp_ntz"))


def resolutions(requests: DataFrame) -> DataFrame:
    """(service, resolved, from_cache, created, hit_rate): a service is made at its first request and kept for the others."""
    n = F.count("*")
    return requests.groupBy("service").agg(n.alias("resolved"), (n - 1).alias("from_cache"), F.lit(1).cast("long").alias("created"), ((n - 1) / n).alias("hit_rate"))


FEATURES = {"core": ("graph",), "analysis": ("impact", "rules", "trends", "diff", "summary", "render"), "language": ("rust", "python", "javascript", "typescript", "java", "go", "c", "cpp"), "streaming": ("stats",), "text corpus": ()}


def features(spark: SparkSession) -> DataFrame:
    """(category, total, always): the engine's features by category, and how many of them are always there; the text operators may be left out."""
    return spark.createDataFrame([(k, max(len(v), 1), len(v)) for k, v in FEATURES.items()], "category string, total int, always int")
