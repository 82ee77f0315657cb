"""T and C: time series, operations, registry, caches."""

from pyspark.sql import functions as F

from ..operators import ops, trends
from .bindings import ctes
from .registry import query

S = f"WITH {ctes('snapshots')}"
NOW = "TIMESTAMP '2024-01-25 00:00:00'"
_cols = "branch, day, ts, commit_hash, complexity, debt, stability, coupling, lines_of_code, cycles, public_apis"
_M = list(trends.METRICS)
_ends = "ends AS (" + " UNION ALL ".join(f"SELECT branch, count(*) AS n, '{m}' AS metric, min_by(CAST({m} AS DOUBLE), (ts, commit_hash)) AS first, max_by(CAST({m} AS DOUBLE), (ts, commit_hash)) AS last FROM snapshots GROUP BY branch HAVING count(*) >= 2" for m in _M) + ")"
_rates = f"""{_ends}, r0 AS (SELECT *, CASE WHEN first = 0 THEN 0 ELSE (last - first) / first * 100 END AS rate FROM ends),
rates AS (SELECT *, CASE WHEN abs(rate) < 1 THEN 'Stable' WHEN (rate > 0) = (metric IN ('stability', 'lines_of_code')) THEN 'Improving' ELSE 'Degrading' END AS direction, CASE WHEN abs(rate) > 50 THEN 'Critical' WHEN abs(rate) > 20 THEN 'High' WHEN abs(rate) > 10 THEN 'Medium' ELSE 'Low' END AS significance FROM r0)"""


def now():
    return F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("t01_record", f"""WITH {ctes('functions')} SELECT file_path, count(*) AS n_functions, round(avg(line_end - line_start), 6) AS avg_length, CAST(max(line_end - line_start) AS BIGINT) AS max_length,
count(*) FILTER (WHERE n_params > 5 OR line_end - line_start > 50) AS high_complexity, count(*) FILTER (WHERE (n_params > 5 OR line_end - line_start > 50) AND line_end - line_start + 5 * n_params > 30) AS needing_refactor, count(*) FILTER (WHERE visibility = 'public') AS public_apis FROM functions GROUP BY file_path""")
def t01(i):
    return _rounded(trends.record(i.bind("functions"), "file_path"), "avg_length")


@query("t02_apidelta", f"""{S}, l AS (SELECT *, lag(public_apis) OVER (PARTITION BY branch ORDER BY ts, commit_hash) AS b FROM snapshots)
SELECT branch, ts, commit_hash, public_apis, CASE WHEN b IS NULL THEN public_apis ELSE greatest(public_apis - b, 0) END AS new_apis, CAST(CASE WHEN b IS NULL THEN 0 ELSE greatest(b - public_apis, 0) END AS BIGINT) AS removed_apis FROM l""")
def t02(i):
    return trends.api_delta(i.bind("snapshots"), "branch")


@query("t03_range", f"{S} SELECT branch, ts, commit_hash FROM snapshots WHERE ts >= {NOW} - INTERVAL 10 DAY")
def t03(i):
    return trends.since(i.bind("snapshots"), now(), 10).select("branch", "ts", "commit_hash")


@query("t04_firstlast", f"{S}, {_ends} SELECT branch, n, metric, round(first, 6) AS first, round(last, 6) AS last FROM ends")
def t04(i):
    return _rounded(trends.first_last(i.bind("snapshots"), "branch"), "first", "last")


@query("t05_rate", f"{S}, {_rates} SELECT branch, metric, round(rate, 6) AS rate, direction, significance FROM rates")
def t05(i):
    return _rounded(trends.change_rates(trends.first_last(i.bind("snapshots"), "branch")), "rate").select("branch", "metric", "rate", "direction", "significance")


@query("t06_overall", f"""{S}, {_rates}, c AS (SELECT branch, count(*) FILTER (WHERE direction = 'Improving') AS u, count(*) FILTER (WHERE direction = 'Degrading') AS d FROM rates GROUP BY branch)
SELECT branch, CASE WHEN u > 0 AND d > 0 THEN 'Mixed' WHEN u > d THEN 'Improving' WHEN d > u THEN 'Degrading' ELSE 'Stable' END AS overall FROM c""")
def t06(i):
    return trends.overall_trend(trends.change_rates(trends.first_last(i.bind("snapshots"), "branch")), "branch")


@query("t07_findings", f"""{S}, {_rates}, f AS (SELECT branch, CASE WHEN metric = 'debt' AND rate > 30 THEN 'debt is rising fast' WHEN metric = 'complexity' AND rate > 20 THEN 'complexity is rising' WHEN metric = 'stability' AND rate < -15 THEN 'interfaces are unstable' END AS finding, round(rate, 6) AS value FROM rates)
SELECT * FROM f WHERE finding IS NOT NULL UNION ALL SELECT branch, 'circular dependencies', CAST(max_by(cycles, (ts, commit_hash)) AS DOUBLE) FROM snapshots GROUP BY branch HAVING max_by(cycles, (ts, commit_hash)) > 0""")
def t07(i):
    s = i.bind("snapshots")
    return trends.key_findings(s, trends.change_rates(trends.first_last(s, "branch")), "branch")


@query("t08_advice", f"""{S}, {_rates} SELECT * FROM (SELECT branch, metric, CASE metric WHEN 'debt' THEN 'plan time to pay debt back' WHEN 'complexity' THEN 'split complex functions' WHEN 'coupling' THEN 'loosen coupled modules' WHEN 'stability' THEN 'freeze public interfaces' END AS advice FROM rates WHERE direction = 'Degrading' AND significance <> 'Low') WHERE advice IS NOT NULL""")
def t08(i):
    return trends.trend_advice(trends.change_rates(trends.first_last(i.bind("snapshots"), "branch")), "branch")


_growth = "g AS (SELECT branch, CASE WHEN b = 0 THEN 0 ELSE (debt - b) / b END AS growth FROM (SELECT *, lag(debt) OVER (PARTITION BY branch ORDER BY ts, commit_hash) AS b, row_number() OVER (PARTITION BY branch ORDER BY ts DESC, commit_hash DESC) AS k FROM snapshots) WHERE k = 1)"


@query("t09_predict", f"""{S}, {_rates}, {_growth}, p AS (SELECT branch, max(n) AS n, max(rate) FILTER (WHERE metric = 'debt') AS dr, max(last) FILTER (WHERE metric = 'debt') AS dl, max(rate) FILTER (WHERE metric = 'complexity') AS cr, max(last) FILTER (WHERE metric = 'complexity') AS cl FROM rates WHERE n >= 5 GROUP BY branch),
q AS (SELECT *, CASE WHEN dr > 10 THEN floor((100 - dl) / (dr / 30)) END AS days FROM p)
SELECT branch, CAST(CASE WHEN days > 0 AND days < 365 THEN days END AS BIGINT) AS days_to_critical, round(cl * (1 + cr / 1200), 6) AS next_complexity, growth > 0.05 AS refactor_soon, CASE WHEN n >= 10 THEN 85 ELSE 70 END AS confidence FROM q JOIN g USING (branch)""")
def t09(i):
    return _rounded(trends.predictions(i.bind("snapshots"), "branch"), "next_complexity")


@query("t10_growth", f"{S}, {_growth} SELECT branch, round(growth, 6) AS growth FROM g")
def t10(i):
    return _rounded(trends.growth(i.bind("snapshots"), "branch", "debt"), "growth")


@query("t11_anomaly", f"""{S}, w AS (SELECT *, row_number() OVER o AS k, avg(debt) OVER (PARTITION BY branch ORDER BY ts, commit_hash ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS dm, avg(complexity) OVER (PARTITION BY branch ORDER BY ts, commit_hash ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS cm FROM snapshots WINDOW o AS (PARTITION BY branch ORDER BY ts, commit_hash))
SELECT branch, ts, 'debt' AS metric, round(debt, 6) AS value, round(dm, 6) AS expected FROM w WHERE k >= 3 AND abs(debt - dm) > 0.05 * dm UNION ALL SELECT branch, ts, 'complexity', round(complexity, 6), round(cm, 6) FROM w WHERE k >= 3 AND abs(complexity - cm) > 0.04 * cm""")
def t11(i):
    return _rounded(trends.anomalies(i.bind("snapshots"), "branch", 0.05, 0.04), "value", "expected")


@query("t12_compare", f"""{S}, k AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY ts, commit_hash) AS u, row_number() OVER (PARTITION BY branch ORDER BY ts DESC, commit_hash DESC) AS d FROM snapshots)
SELECT a.branch, round(b.debt - a.debt, 6) AS debt_change, round(b.complexity - a.complexity, 6) AS complexity_change, round(b.stability - a.stability, 6) AS stability_change FROM k a JOIN k b ON a.branch = b.branch AND a.u = 2 AND b.d = 1""")
def t12(i):
    return _rounded(trends.compare(i.bind("snapshots"), "branch", 2, 0), "debt_change", "complexity_change", "stability_change")


@query("t12_by_commit", f"{S} SELECT branch, commit_hash FROM snapshots WHERE starts_with(commit_hash, 'c1')")
def t12b(i):
    return trends.by_commit(i.bind("snapshots"), "c1").select("branch", "commit_hash")


@query("t13_retention", f"{S} SELECT branch, ts > {NOW} - INTERVAL 7 DAY AS kept, count(*) AS n FROM snapshots GROUP BY ALL")
def t13(i):
    s = i.bind("snapshots")
    kept = trends.retain(s, now(), 7).withColumn("kept", F.lit(True))
    gone = s.join(kept.select("branch", "commit_hash"), ["branch", "commit_hash"], "left_anti").withColumn("kept", F.lit(False))
    return kept.unionByName(gone).groupBy("branch", "kept").agg(F.count("*").alias("n"))


@query("t14_list", f"{S} SELECT * FROM (SELECT branch, ts, commit_hash, true AS newest FROM snapshots ORDER BY ts DESC, commit_hash DESC, branch DESC LIMIT 20) UNION ALL SELECT * FROM (SELECT branch, ts, commit_hash, false FROM snapshots WHERE branch = 'error' ORDER BY ts, commit_hash, branch LIMIT 10)")
def t14(i):
    s = i.bind("snapshots").select("branch", "ts", "commit_hash")
    return trends.listed(s, 20).withColumn("newest", F.lit(True)).unionByName(trends.listed(s, 10, False, "error").withColumn("newest", F.lit(False)))


@query("t15_merge", f"""{S}, u AS (SELECT branch, ts, 'c' || (public_apis % 3) AS commit_hash FROM snapshots WHERE branch IN ('click', 'error', 'view')), l AS (SELECT *, lag(commit_hash) OVER (ORDER BY ts, commit_hash, branch) AS b FROM u) SELECT branch, ts, commit_hash FROM l WHERE b IS NULL OR b <> commit_hash""")
def t15(i):
    s = i.bind("snapshots").select("branch", "ts", F.concat(F.lit("c"), (F.col("public_apis") % 3).cast("string")).alias("commit_hash"))
    return trends.merged(s.where("branch in ('click', 'view')"), s.where("branch = 'error'"))


@query("t16_stats", f"{S} SELECT count(*) AS n_snapshots, count(DISTINCT branch) AS n_branches, min(ts) AS oldest, max(ts) AS newest, CAST(sum(lines_of_code) AS BIGINT) AS n_lines FROM snapshots")
def t16(i):
    return trends.storage_stats(i.bind("snapshots"))


@query("t17_expired", f"SELECT event_id FROM events WHERE ts < {NOW} - INTERVAL 20 DAY")
def t17(i):
    return trends.expired_files(i.table("events").withColumn("modified", F.col("ts")), now(), 20).select("event_id")


C = f"WITH {ctes('tool_calls')}"
_stat = "count(*) AS calls, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed"


@query("c01_toolstats", f"{C} SELECT tool, {_stat}, round(sum(duration_ms), 6) AS total_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, round(avg(duration_ms), 6) AS avg_ms FROM tool_calls GROUP BY tool")
def c01(i):
    return _rounded(ops.tool_stats(i.bind("tool_calls")), "total_ms", "avg_ms")


@query("c02_totals", f"{C} SELECT {_stat}, round(sum(duration_ms) / count(*), 6) AS avg_ms FROM tool_calls")
def c02(i):
    return _rounded(ops.totals(i.bind("tool_calls")), "avg_ms")


_services = f"WITH {ctes('services', 'requirements')}"


@query("c03_service_by_tool", f"{_services} SELECT service FROM services WHERE tool = 'Brand#11' OR version LIKE '1.%'")
def c03(i):
    s = i.bind("services").withColumn("tools", F.array_compact(F.array("tool", F.when(F.col("version").startswith("1."), "Brand#11"))))
    return ops.by_tool(s, "Brand#11").select("service")


_v = lambda c: f"[CAST(x AS INTEGER) FOR x IN string_split(ltrim({c}, '>='), '.')]"


@query("c04_unmet", f"""{_services} SELECT * FROM (SELECT r.service, r.needs, CASE WHEN s.service IS NULL THEN 'missing' WHEN {_v('s.version')} < {_v('r.wanted')} THEN 'version' WHEN s.status <> 'Up' THEN 'not up' END AS problem FROM requirements r LEFT JOIN services s ON r.needs = s.service WHERE NOT optional) WHERE problem IS NOT NULL""")
def c04(i):
    return ops.unmet_dependencies(i.bind("services"), i.bind("requirements"))


@query("c05_required", f"{_services} SELECT service FROM services WHERE service IN (SELECT needs FROM requirements WHERE NOT optional)")
def c05(i):
    return ops.required_dependents(i.bind("services"), i.bind("requirements")).select("service")


@query("b11_service_edges", f"{_services} SELECT r.service AS src, r.needs AS dst FROM requirements r JOIN services a ON r.service = a.service JOIN services b ON r.needs = b.service")
def b11(i):
    return ops.dependency_edges(i.bind("services"), i.bind("requirements"))


@query("c06_statuschange", "SELECT event_id, user_id, event_type, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type")
def c06(i):
    return ops.status_changes(i.table("events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "event_type", "before")


@query("c07_dedup", "SELECT md5(text) AS key, lang AS language, count(*) AS n FROM documents GROUP BY ALL")
def c07(i):
    return ops.cache_keys(i.table("documents"), "text", "lang")


@query("c08_hitrate", "WITH k AS (SELECT count(*) AS n FROM documents GROUP BY md5(text), lang) SELECT CAST(sum(n - 1) AS BIGINT) AS hits, count(*) AS misses, round(CAST(sum(n - 1) AS DOUBLE) / sum(n), 6) AS hit_rate FROM k")
def c08(i):
    return _rounded(ops.hit_rate(i.table("documents"), "text", "lang"), "hit_rate")


@query("c09_expire", f"SELECT event_id FROM events WHERE ts >= {NOW} - INTERVAL 3600 SECOND")
def c09(i):
    return ops.fresh_entries(i.table("events").withColumn("created", F.col("ts")), now(), 3600).select("event_id")


@query("c10_review_cache", f"SELECT md5('{{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}}') AS key, ts AS created FROM events WHERE ts >= {NOW} - INTERVAL 86400 SECOND ORDER BY created DESC, key DESC LIMIT 100")
def c10(i):
    e = i.table("events")
    return ops.fresh_entries(e.select(ops.canonical_key(e, ["user_id", "event_type"]).alias("key"), F.col("ts").alias("created")), now(), 86400, 100)


@query("c11_refresh_due", f"SELECT event_id FROM events WHERE event_id % 10 = 0 OR {NOW} - INTERVAL 86400 SECOND > ts")
def c11(i):
    return ops.refresh_due(i.table("events").withColumn("refreshed", F.when(F.col("event_id") % 10 != 0, F.col("ts"))), now(), 86400).select("event_id")
