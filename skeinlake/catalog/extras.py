"""Writers read back, scalar scores, and start order of services."""

from pyspark.sql import functions as F

from ..functions.lookups import EDGE_FACTORS, TYPE_FACTORS, case, sql_case
from ..operators import graph, impact
from ..plans.tables import passing
from ..sources import json
from .bindings import ctes
from .registry import query

S = f"WITH {ctes('snapshots')}"
_kept = "branch, ts, commit_hash, debt, lines_of_code"


def _store(i):
    return passing(i.spark, "snapshots")


def _rows(i):
    return i.bind("snapshots").select("branch", "ts", "commit_hash", "debt", "complexity", "lines_of_code", F.array().cast("array<string>").alias("tags"))


@query("s17_all_branches", f"{S} SELECT branch, count(*) AS n FROM snapshots WHERE branch <> 'error' GROUP BY branch")
def s17(i):
    name = F.when(F.col("branch") == "error", "other.jsonl").otherwise(F.concat(F.lit("x/snapshots_"), "branch", F.lit(".jsonl")))
    return i.bind("snapshots").select(json.branch_of(name).alias("branch")).where("branch <> ''").groupBy("branch").agg(F.count("*").alias("n"))


@query("k01_append", f"{S} SELECT {_kept} FROM snapshots UNION ALL SELECT {_kept} FROM snapshots WHERE branch = 'click'")
def k01(i):
    at, s = _store(i), _rows(i)
    json.append_snapshots(s, at)
    json.append_snapshots(s.where("branch = 'click'"), at)
    return json.read_appended(i.spark, at).select(*_kept.split(", "))


@query("k02_overwrite", f"{S} SELECT {_kept} FROM snapshots WHERE branch <> 'click' OR lines_of_code % 2 = 0")
def k02(i):
    at, s = _store(i), _rows(i)
    json.append_snapshots(s, at)
    json.overwrite_branches(s.where("branch = 'click' and lines_of_code % 2 = 0"), at)
    return json.read_appended(i.spark, at).select(*_kept.split(", "))


_kind = "CASE p_partkey % 4 WHEN 0 THEN 'Function' WHEN 1 THEN 'Class' WHEN 2 THEN 'Module' ELSE 'File' END"
_edge = "CASE p_partkey % 3 WHEN 0 THEN 'Calls' WHEN 1 THEN 'Imports' ELSE 'Other' END"


@query("p02_step_score", f"SELECT p_partkey, round(0.9::DOUBLE * pow(0.8::DOUBLE, p_size % 4) * {sql_case(_edge, EDGE_FACTORS, '0.4::DOUBLE')} * (p_size / 50.0::DOUBLE) * {sql_case(_kind, TYPE_FACTORS)}, 9) AS score FROM part")
def p02(i):
    score = impact.step_score(F.lit(0.9), F.col("p_size") % 4, impact.edge_factor(F.expr(_edge), 0.4), F.col("p_size") / 50, case(F.expr(_kind), TYPE_FACTORS))
    return i.table("part").select("p_partkey", F.round(score, 9).alias("score"))


@query("p10_hop_chance", f"SELECT p_partkey, round({sql_case(_edge, EDGE_FACTORS, '0.5::DOUBLE')} * 0.85::DOUBLE * least(1::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * (p_size / 30.0::DOUBLE)), 9) AS p FROM part")
def p10(i):
    return i.table("part").select("p_partkey", F.round(impact.hop_chance(impact.edge_factor(F.expr(_edge), 0.5), F.col("p_size") / 30), 9).alias("p"))


@query("p11_severity", "SELECT p_partkey, CASE WHEN p_size / 50 > 0.8 OR p_partkey % 7 >= 5 OR p_partkey % 10 / 30 > 0.25 THEN 'High' WHEN p_size / 50 > 0.6 OR p_partkey % 7 >= 4 OR p_partkey % 10 / 30 > 0.15 THEN 'Medium' ELSE 'Low' END AS severity FROM part")
def p11(i):
    k = F.col("p_partkey")
    return i.table("part").select("p_partkey", impact.chain_severity(F.col("p_size") / 50, k % 7, k % 10 / 30).alias("severity"))


@query("c14_start_order", f"WITH RECURSIVE {ctes('requirements')}, v AS (SELECT 's' || p_partkey AS id FROM part), e AS (SELECT needs AS src, service AS dst FROM requirements), r(id, level) AS (SELECT id, 0 FROM v UNION SELECT dst, level + 1 FROM r JOIN e ON e.src = r.id) SELECT id, max(level) AS level FROM r GROUP BY id")
def c14(i):
    r = i.bind("requirements").select(F.col("needs").alias("src"), F.col("service").alias("dst"))
    return graph.levels(i.bind("services").select(F.col("service").alias("id")), r)
