"""R: rules, scores and risk."""

from pyspark.sql import functions as F

from ..functions.lookups import CHANGE_IMPACT, CHANGE_RISK, RISK_RANK, RISK_SCORE, sql_case
from ..operators import rules
from .bindings import ctes
from .registry import query

_risk = sql_case("change_type", CHANGE_RISK)
_w = f"WITH {ctes('changes')}, r AS (SELECT *, {_risk} AS risk FROM changes)"
_spots = "SELECT file_path, name, ord, CAST(line_end - line_start + 5 * n_params AS DOUBLE) AS score, list_filter([CASE WHEN n_params > 5 THEN 'too many parameters' END, CASE WHEN line_end - line_start > 50 THEN 'too long' END], lambda x: x IS NOT NULL) AS reasons FROM functions WHERE n_params > 5 OR line_end - line_start > 50"
_score = f"SELECT review, CAST(coalesce(least(floor(sum({sql_case('risk', {k: v[0] * v[1] for k, v in RISK_SCORE.items()}, '0')}) / sum({sql_case('risk', {k: v[1] for k, v in RISK_SCORE.items()}, '0')})), 100), 0) AS BIGINT) AS risk_score FROM r GROUP BY review"


@query("r01_risk", f"{_w} SELECT change_id, review, change_type, component, risk, {sql_case('change_type', CHANGE_IMPACT)} AS impact FROM r")
def r01(i):
    return rules.change_risk(i.bind("changes"))


@query("r02_overall", f"{_w} SELECT review, {sql_case(f'max({sql_case("risk", RISK_RANK, "0")})', {v: k for k, v in RISK_RANK.items()})} AS overall_risk FROM r GROUP BY review")
def r02(i):
    return rules.overall_risk(i.bind("changes"), "review")


@query("r03_riskscore", f"{_w} {_score}")
def r03(i):
    return rules.risk_score(i.bind("changes"), "review")


@query("r04_impact_levels", f"WITH {ctes('changes')} SELECT {sql_case('change_type', CHANGE_IMPACT)} AS impact, count(*) AS n FROM changes GROUP BY 1")
def r04(i):
    return rules.change_risk(i.bind("changes")).groupBy("impact").agg(F.count("*").alias("n"))


@query(
    "r05_mitigations",
    f"""{_w}, s AS ({_score}), u AS (
  SELECT review, CAST(-1 AS BIGINT) AS at_, CASE {' '.join(f"WHEN risk_score >= {n} THEN '{a}'" for n, a in rules.ADVICE)} END AS advice FROM s
  UNION ALL SELECT review, min(change_id), advice FROM (SELECT *, {sql_case('change_type', rules.SUGGESTIONS)} AS advice FROM r) GROUP BY review, advice)
SELECT review, CAST(row_number() OVER (PARTITION BY review ORDER BY at_, advice) AS INTEGER) AS place, advice FROM u WHERE advice IS NOT NULL""",
)
def r05(i):
    return rules.mitigations(i.bind("changes"), "review")


@query("r06_changes_of_risk", f"{_w} SELECT change_id, review, change_type, component FROM r WHERE risk = 'Critical' AND change_type = 'InterfaceChanged'")
def r06(i):
    return rules.of_kind(i.bind("changes"), "InterfaceChanged", "Critical")


@query(
    "r07_violations",
    f"""WITH {ctes('functions', 'classes')} SELECT file_path, name, 'large class' AS violation, 'Medium' AS severity FROM classes WHERE n_methods > 20
UNION ALL SELECT file_path, name, 'long function', CASE WHEN line_end - line_start > 100 THEN 'High' ELSE 'Medium' END FROM functions WHERE line_end - line_start > 50""",
)
def r07(i):
    return rules.pattern_violations(i.bind("functions"), i.bind("classes"))


@query("r08_hotspots", f"WITH {ctes('functions')} {_spots}")
def r08(i):
    return rules.hotspots(i.bind("functions"))


@query("r09_debt", f"WITH {ctes('functions')}, s AS ({_spots}) SELECT file_path, CAST(count(*) * 10 AS DOUBLE) AS debt, CAST(count(*) * 2.5 AS DOUBLE) AS hours FROM s GROUP BY file_path")
def r09(i):
    return rules.debt(rules.hotspots(i.bind("functions")), "file_path")


@query(
    "r10_impact",
    f"""{_w}, s AS (SELECT review, CAST(10 * count(*) FILTER (WHERE risk IN ('Critical', 'High')) + 5 * count(DISTINCT component) AS BIGINT) AS score FROM r GROUP BY review)
SELECT *, CASE WHEN score > 50 THEN 'Critical' WHEN score > 30 THEN 'High' WHEN score > 10 THEN 'Medium' ELSE 'Low' END AS band FROM s""",
)
def r10(i):
    return rules.insight_impact(i.bind("changes"), "review")


@query("r11_public_api", f"WITH {ctes('functions')} SELECT file_path, name, n_params, 'function' AS kind FROM functions WHERE visibility = 'public'")
def r11(i):
    return rules.public_api(i.bind("functions"))


@query("r13_long_texts", f"WITH {ctes('doc_lines')} SELECT doc_id, count(*) AS n_lines FROM doc_lines GROUP BY doc_id HAVING count(*) > 100")
def r13_long(i):
    return rules.long_texts(i.bind("doc_lines"), "doc_id")


@query("r13_todo", f"WITH {ctes('doc_lines')} SELECT doc_id, pos, trim(line) AS line FROM doc_lines WHERE regexp_matches(lower(line), 'licensed|password|token')")
def r13_todo(i):
    return rules.marker_lines(i.bind("doc_lines"), "doc_id", ("licensed", "password", "token"))


@query(
    "r13_runs",
    f"""WITH {ctes('doc_lines')}, solid AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS a, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS b FROM doc_lines WHERE trim(line) <> ''),
runs AS (SELECT doc_id, line, min(pos) AS pos, count(*) AS run FROM solid GROUP BY doc_id, line, a - b HAVING count(*) >= 4)
SELECT doc_id, line, pos, run FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1""",
)
def r13_runs(i):
    return rules.repeated_lines(i.bind("doc_lines"), "doc_id")


_patterns = [("en", "tion"), ("en", "the "), ("fr", "eau"), ("de", "sch"), ("es", "ción"), ("es", "the ")]


@query("r14_patterns", f"WITH {ctes('doc_lines')}, p(l, pattern) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _patterns)}) SELECT doc_id, lang, pos, pattern FROM doc_lines JOIN p ON lang = l AND contains(line, pattern)")
def r14(i):
    return rules.risky_patterns(i.bind("doc_lines"), "doc_id", i.spark.createDataFrame(_patterns, "lang string, pattern string"))


@query(
    "r15_structure_rules",
    f"""WITH {ctes('functions', 'classes')}
SELECT file_path, CAST(NULL AS VARCHAR) AS name, 'too many functions' AS rule, count(*) AS n FROM functions GROUP BY file_path HAVING count(*) > 20
UNION ALL SELECT file_path, NULL, 'too many classes', count(*) FROM classes GROUP BY file_path HAVING count(*) > 5
UNION ALL SELECT file_path, name, 'function too long', CAST(line_end - line_start AS BIGINT) FROM functions WHERE line_end - line_start > 50
UNION ALL SELECT file_path, name, 'too many parameters', CAST(n_params AS BIGINT) FROM functions WHERE n_params > 5""",
)
def r15(i):
    return rules.structure_rules(i.bind("functions"), i.bind("classes"))


@query(
    "r16_summary",
    f"""WITH {ctes('findings')}, s AS (SELECT target, {', '.join(f"count(*) FILTER (WHERE severity = '{x}') AS {x.lower()}" for x in ('Critical', 'High', 'Medium', 'Low'))}, count(*) AS total FROM findings GROUP BY target)
SELECT *, CAST(greatest(0, 100 - 20 * critical - 10 * high - 5 * medium - 2 * low) AS BIGINT) AS architecture_score, CASE WHEN critical > 0 THEN 'critical issues' WHEN high > 0 THEN 'high risk' WHEN medium > 0 THEN 'needs work' ELSE 'good' END AS verdict FROM s""",
)
def r16(i):
    return rules.insight_summary(i.bind("findings"), "target")


@query("r17_recommendations", f"WITH {ctes('findings')} SELECT DISTINCT target, {sql_case('category', rules.CATEGORY_ADVICE)} AS advice FROM findings")
def r17(i):
    return rules.category_advice(i.bind("findings"), "target")


_answer = "'{\"issues\":[{\"message\":\"m' || event_id || '\"' || CASE WHEN event_id % 2 = 0 THEN ',\"severity\":\"High\"' ELSE '' END || '}],\"coverage\":' || CASE event_id % 3 WHEN 0 THEN '0.5' WHEN 1 THEN '0.9' ELSE 'null' END || ',\"deviations\":[' || CASE WHEN event_id % 5 = 0 THEN '{\"message\":\"d\"}' ELSE '' END || ']}'"


@query(
    "r18_model_insights",
    """SELECT event_id AS id, 'issue' AS kind, 'm' || event_id AS message, CASE WHEN event_id % 2 = 0 THEN 'High' ELSE 'Medium' END AS severity FROM events
UNION ALL SELECT event_id, 'coverage', 'coverage 50%', 'Medium' FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'deviation', 'd', 'Medium' FROM events WHERE event_id % 5 = 0""",
)
def r18(i):
    return rules.model_insights(i.table("events").select(F.col("event_id").alias("id"), F.expr(_answer).alias("body")))


@query(
    "r19_review_score",
    """WITH l AS (SELECT conv_id, CAST(turn AS INTEGER) AS pos, 'Score: ' || (conv_id * 7 + turn * 13) % 150 || ' points' AS line FROM conversations WHERE role <> 'system' UNION ALL SELECT conv_id, CAST(turn AS INTEGER), 'nothing' FROM conversations WHERE role = 'system'),
h AS (SELECT conv_id, min_by(CAST(regexp_extract(line, '([0-9]+)', 1) AS DOUBLE), pos) AS said FROM l WHERE line LIKE 'Score%' AND CAST(regexp_extract(line, '([0-9]+)', 1) AS DOUBLE) <= 100 GROUP BY conv_id),
b AS (SELECT conv_id, count(*) AS bad FROM conversations WHERE turn % 4 = 1 GROUP BY conv_id)
SELECT conv_id, greatest(CAST(0 AS DOUBLE), coalesce(said, CAST(85 AS DOUBLE)) - 10 * coalesce(bad, 0)) AS score FROM (SELECT DISTINCT conv_id FROM l) LEFT JOIN h USING (conv_id) LEFT JOIN b USING (conv_id)""",
)
def r19(i):
    c = i.table("conversations")
    line = F.when(F.col("role") == "system", "nothing").otherwise(F.concat(F.lit("Score: "), ((F.col("conv_id") * 7 + F.col("turn") * 13) % 150).cast("string"), F.lit(" points")))
    found = c.select("conv_id", F.when(F.col("turn") % 4 == 1, "High").otherwise("Low").alias("severity"))
    return rules.review_score(c.select("conv_id", F.col("turn").cast("int").alias("pos"), line.alias("line")), "conv_id", found)


@query("r20_key_value", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def r20(i):
    return i.table("events").select("event_id", rules.key_value(F.regexp_replace("props", '"', ""), "k").alias("k"))


@query("r21_levels", f"WITH {ctes('findings')} SELECT CASE upper(scanner_severity) WHEN 'ERROR' THEN 'Error' WHEN 'WARNING' THEN 'Warning' ELSE 'Info' END AS level, count(*) AS n FROM findings GROUP BY 1")
def r21(i):
    return rules.severity_levels(i.bind("findings"))


@query("r22_bands", "SELECT CASE WHEN p_size <= 5 THEN 'simple' WHEN p_size <= 10 THEN 'moderate' WHEN p_size <= 20 THEN 'complex' WHEN p_size <= 50 THEN 'very complex' ELSE 'unmaintainable' END AS band, count(*) AS n FROM part GROUP BY 1")
def r22(i):
    return i.table("part").groupBy(rules.complexity_band(F.col("p_size")).alias("band")).agg(F.count("*").alias("n"))


@query(
    "r23_quality",
    """SELECT p_partkey, round(least(greatest(100 - 2 * greatest(p_size - 10, 0) - CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 0.5 * (p_partkey % 20) END - CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 0.5 * greatest(80 - p_retailprice / 20, 0) END - 10 * (p_partkey % 2) * 0.1 - 2 * (p_partkey % 5) - 10 * (p_partkey % 3), 0), 100), 6)::DOUBLE AS score FROM part""",
)
def r23(i):
    k = F.col("p_partkey")
    score = rules.quality_score(F.col("p_size").cast("double"), F.when(k % 3 != 0, k % 20), F.when(k % 4 != 0, F.col("p_retailprice") / 20), (k % 2) * F.lit(0.1), k % 5, k % 3)
    return i.table("part").select("p_partkey", F.round(score, 6).alias("score"))
