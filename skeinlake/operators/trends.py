"""The time series of quality snapshots: trends, predictions, anomalies, comparison, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metric columns and whether a higher value is better.
METRICS = {"complexity": False, "debt": False, "stability": True, "coupling": False, "lines_of_code": True}


def since(snapshots: DataFrame, now: Column, days: int) -> DataFrame:
    """Snapshots of the last days, the bound included."""
    return snapshots.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))


def record(functions: DataFrame, by: str, refactor_score: float = 30.0) -> DataFrame:
    """One row of snapshot metrics for each group of functions: lengths, hotspots, those that need refactoring, public ones."""
    length = (F.col("line_end") - F.col("line_start")).cast("double")
    hot = (F.col("n_params") > 5) | (length > 50)
    return functions.groupBy(by).agg(
        F.count("*").alias("n_functions"), F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_length"), F.coalesce(F.max(length), F.lit(0.0)).cast("long").alias("max_length"),
        F.count_if(hot).alias("high_complexity"), F.count_if(hot & (length + 5 * F.col("n_params") > refactor_score)).alias("needing_refactor"), F.count_if(F.col("visibility") == "public").alias("public_apis"),
    )


def api_delta(snapshots: DataFrame, by: str) -> DataFrame:
    """New and removed public APIs against the snapshot before, 0 at least; the first has all new."""
    before = F.lag("public_apis").over(Window.partitionBy(by).orderBy("ts", "commit_hash"))
    return snapshots.select(by, "ts", "commit_hash", "public_apis", F.when(before.isNull(), F.col("public_apis")).otherwise(F.greatest(F.col("public_apis") - before, F.lit(0))).alias("new_apis"), F.when(before.isNull(), F.lit(0)).otherwise(F.greatest(before - F.col("public_apis"), F.lit(0))).cast("long").alias("removed_apis"))


def first_last(snapshots: DataFrame, by: str) -> DataFrame:
    """(by, metric, first, last, n): each metric at the first and last snapshot; groups of one are left out."""
    ends = []
    key = F.struct("ts", "commit_hash")
    for m in METRICS:
        ends += [F.min_by(F.col(m).cast("double"), key).alias(f"{m}_0"), F.max_by(F.col(m).cast("double"), key).alias(f"{m}_1")]
    wide = snapshots.groupBy(by).agg(F.count("*").alias("n"), *ends).where("n >= 2")
    pairs = ", ".join(f"'{m}', {m}_0, {m}_1" for m in METRICS)
    return wide.selectExpr(by, "n", f"stack({len(METRICS)}, {pairs}) as (metric, first, last)")


def change_rates(ends: DataFrame) -> DataFrame:
    """Adds rate in percent (0 from a base of 0), direction and significance."""
    better = F.col("metric").isin([m for m, up in METRICS.items() if up])
    rate = F.when(F.col("first") == 0, F.lit(0.0)).otherwise((F.col("last") - F.col("first")) / F.col("first") * 100)
    direction = F.when(F.abs("rate") < 1, "Stable").when((F.col("rate") > 0) == better, "Improving").otherwise("Degrading")
    size = F.when(F.abs("rate") > 50, "Critical").when(F.abs("rate") > 20, "High").when(F.abs("rate") > 10, "Medium").otherwise("Low")
    return ends.withColumn("rate", rate).withColumn("direction", direction).withColumn("significance", size)


def overall_trend(rates: DataFrame, by: str) -> DataFrame:
    """Mixed if metrics improve and others degrade, else what more of them do, else Stable."""
    up, down = F.count_if(F.col("direction") == "Improving"), F.count_if(F.col("direction") == "Degrading")
    return rates.groupBy(by).agg(up.alias("up"), down.alias("down")).select(by, F.when((F.col("up") > 0) & (F.col("down") > 0), "Mixed").when(F.col("up") > F.col("down"), "Improving").when(F.col("down") > F.col("up"), "Degrading").otherwise("Stable").alias("overall"))


def key_findings(snapshots: DataFrame, rates: DataFrame, by: str) -> DataFrame:
    """Debt up by over 30 %, complexity by over 20 %, stability down by over 15 %, and cycles at the last snapshot."""
    over = F.when((F.col("metric") == "debt") & (F.col("rate") > 30), "debt is rising fast").when((F.col("metric") == "complexity") & (F.col("rate") > 20), "complexity is rising").when((F.col("metric") == "stability") & (F.col("rate") < -15), "interfaces are unstable")
    a = rates.select(by, over.alias("finding"), F.round("rate", 6).alias("value")).where("finding is not null")
    last = snapshots.groupBy(by).agg(F.max_by("cycles", F.struct("ts", "commit_hash")).alias("cycles")).where("cycles > 0")
    return a.unionByName(last.select(by, F.lit("circular dependencies").alias("finding"), F.col("cycles").cast("double").alias("value")))


def trend_advice(rates: DataFrame, by: str, faithful: bool = False) -> DataFrame:
    """Advice for metrics that degrade significantly (Medium on). faithful: only Medium and Low ones get it, the order of levels being reversed where it is compared."""
    levels = ("Medium", "Low") if faithful else ("Medium", "High", "Critical")
    text = F.when(F.col("metric") == "debt", "plan time to pay debt back").when(F.col("metric") == "complexity", "split complex functions").when(F.col("metric") == "coupling", "loosen coupled modules").when(F.col("metric") == "stability", "freeze public interfaces")
    return rates.where((F.col("direction") == "Degrading") & F.col("significance").isin(*levels)).select(by, "metric", text.alias("advice")).where("advice is not null")


def growth(snapshots: DataFrame, by: str, metric: str) -> DataFrame:
    """Relative growth of a metric over the last two snapshots, 0 from a base of 0; null with one snapshot."""
    w = Window.partitionBy(by).orderBy("ts", "commit_hash")
    ranked = snapshots.select(by, F.col(metric).cast("double").alias("v"), F.lag(F.col(metric).cast("double")).over(w).alias("before"), F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("commit_hash"))).alias("k"))
    return ranked.where("k = 1").select(by, F.when(F.col("before") == 0, F.lit(0.0)).otherwise((F.col("v") - F.col("before")) / F.col("before")).alias("growth"))


def predictions(snapshots: DataFrame, by: str) -> DataFrame:
    """For groups of five snapshots or more: days until debt reaches 100, complexity next month, whether to refactor within 14 days, confidence."""
    rates = change_rates(first_last(snapshots, by)).where("n >= 5")
    per = rates.groupBy(by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in ("debt", "complexity") for c in ("rate", "last")])
    days = F.when(F.col("debt_rate") > 10, F.floor((100 - F.col("debt_last")) / (F.col("debt_rate") / 30)))
    out = per.join(growth(snapshots, by, "debt"), by)
    return out.select(by, F.when((days > 0) & (days < 365), days).cast("long").alias("days_to_critical"), (F.col("complexity_last") * (1 + F.col("complexity_rate") / 1200)).alias("next_complexity"), (F.col("growth") > 0.05).alias("refactor_soon"), F.when(F.col("n") >= 10, 85).otherwise(70).alias("confidence"))


def anomalies(snapshots: DataFrame, by: str, debt: float = 0.5, complexity: float = 0.4) -> DataFrame:
    """Rows from the third on that differ from the mean of the two before by more than a share of it: (by, ts, metric, value, expected)."""
    order = Window.partitionBy(by).orderBy("ts", "commit_hash")
    frame = order.rowsBetween(-2, -1)
    marked = snapshots.select(by, "ts", F.row_number().over(order).alias("k"), *[F.col(m).cast("double").alias(m) for m in ("debt", "complexity")], *[F.avg(F.col(m).cast("double")).over(frame).alias(f"{m}_mean") for m in ("debt", "complexity")]).where("k >= 3")
    parts = [marked.where(F.abs(F.col(m) - F.col(f"{m}_mean")) > share * F.col(f"{m}_mean")).select(by, "ts", F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"{m}_mean").alias("expected")) for m, share in (("debt", debt), ("complexity", complexity))]
    return parts[0].unionByName(parts[1])


def compare(snapshots: DataFrame, by: str, old: int, new: int) -> DataFrame:
    """Differences of debt, complexity and stability between two snapshots, by their 1-based places in time; 0 is the latest."""
    asc, desc = Window.partitionBy(by).orderBy("ts", "commit_hash"), Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("commit_hash"))
    s = snapshots.withColumns({"up": F.row_number().over(asc), "down": F.row_number().over(desc)})
    pick = lambda k, name: s.where(F.col("down") == 1 if k == 0 else F.col("up") == k).select(by, *[F.col(m).alias(f"{m}_{name}") for m in ("debt", "complexity", "stability")])
    return pick(old, "a").join(pick(new, "b"), by).select(by, *[(F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"{m}_change") for m in ("debt", "complexity", "stability")])


def by_commit(snapshots: DataFrame, prefix: str) -> DataFrame:
    """Snapshots whose commit begins so."""
    return snapshots.where(F.col("commit_hash").startswith(prefix))


def retain(snapshots: DataFrame, now: Column, days: int) -> DataFrame:
    """Snapshots younger than so many days."""
    return snapshots.where(F.col("ts") > now - F.make_dt_interval(F.lit(days)))


def listed(snapshots: DataFrame, n: int, newest: bool = True, branch: str | None = None) -> DataFrame:
    """The newest so many snapshots, as a table shows them, or the oldest, as JSON lists them; of one branch if given."""
    out = snapshots if branch is None else snapshots.where(F.col("branch") == branch)
    order = [F.desc("ts"), F.desc("commit_hash"), F.desc("branch")] if newest else ["ts", "commit_hash", "branch"]
    return out.orderBy(*order).limit(n)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both branches in time order without a snapshot whose commit is that of the one just before it. One history is ordered, so one task sorts it; callers merge two branches, not all."""
    both = a.unionByName(b)
    before = F.lag("commit_hash").over(Window.orderBy("ts", "commit_hash", "branch"))
    return both.withColumn("before", before).where("before is null or before <> commit_hash").drop("before")


def storage_stats(snapshots: DataFrame) -> DataFrame:
    """Count, branches, first and last time, and bytes as JSON."""
    return snapshots.agg(F.count("*").alias("n_snapshots"), F.countDistinct("branch").alias("n_branches"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.coalesce(F.sum("lines_of_code"), F.lit(0)).cast("long").alias("n_lines"))


def expired_files(files: DataFrame, now: Column, days: int) -> DataFrame:
    """Files last changed longer ago than so many days."""
    return files.where(F.col("modified") < now - F.make_dt_interval(F.lit(days)))
