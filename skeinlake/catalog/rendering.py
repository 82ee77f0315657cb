"""K and G23 to G25: text output and the summary."""

from pyspark.sql import functions as F

from ..functions.lookups import CHANGE_RISK, sql_case
from ..operators import graph, impact, render, rules, summary
from .bindings import ctes
from .graphs import _propagation
from .registry import ORACLES, query
from .trends import S, _rates

FL = f"WITH {ctes('flow_vertices', 'flow_edges')}, vertices AS (SELECT * FROM flow_vertices), edges AS (SELECT * FROM flow_edges)"
_label = "CASE node_type WHEN 'Function' THEN 'fn ' || name || '()' WHEN 'Class' THEN 'class ' || name WHEN 'Module' THEN 'mod ' || name ELSE 'file ' || name END"
_num = "v AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n FROM vertices)"
_key = "src || chr(31) || dst || chr(31) || edge_type"


def _flow(i):
    return i.bind("flow_vertices"), i.bind("flow_edges")


_shape, _colour = sql_case("node_type", render.SHAPES, "'ellipse'"), sql_case("edge_type", render.COLOURS, "'black'")


@query("k05_dot", f"""{FL} SELECT 0 AS part, '' AS key, 'digraph G {{' AS line UNION ALL SELECT 3, '', '}}' UNION ALL SELECT 1, id, '  "' || id || '" [label="' || {_label} || '", shape=' || {_shape} || '];' FROM vertices
UNION ALL SELECT 2, {_key}, '  "' || src || '" -> "' || dst || '" [label="' || edge_type || '", color="' || {_colour} || '", weight="' || printf('%.2f', weight) || '"];' FROM edges""")
def k05(i):
    return render.dot_lines(*_flow(i), weights=True)


@query("g25_highlight", f"""{FL} SELECT 1 AS part, id AS key, '  "' || id || '" [label="' || {_label} || '", shape=' || {_shape} || CASE WHEN (SELECT count(*) FROM edges WHERE src = id OR dst = id) / (2 * (SELECT count(*) FROM vertices)) > 0.5 THEN ', color="red", penwidth=2' ELSE '' END || '];' AS line FROM vertices""")
def g25(i):
    v, e = _flow(i)
    return render.dot_lines(v, e, graph.critical(v, e, 0.5)).where("part = 1")


@query("k06_mermaid", f"""{FL}, {_num} SELECT 0 AS part, '' AS key, 'flowchart TD' AS line UNION ALL SELECT 1, lpad(CAST(n AS VARCHAR), 12, '0'), '  N' || n || '["' || {_label} || '"]' FROM v
UNION ALL SELECT 2, {_key}, '  N' || a.n || ' ' || {sql_case('edge_type', render.ARROWS, "'-->'")} || ' N' || b.n FROM edges JOIN v a ON a.id = src JOIN v b ON b.id = dst""")
def k06(i):
    return render.mermaid_lines(*_flow(i))


@query("k07_ascii", f"""{FL}, {_num} SELECT 0 AS part, lpad(CAST(n AS VARCHAR), 12, '0') AS key, 'N' || n || ' [' || {_label} || '] @ ' || file_path || ' importance=' || printf('%.2f', importance) AS line FROM v
UNION ALL SELECT 1, {_key}, 'N' || a.n || ' -> N' || b.n || ' (' || edge_type || ')' FROM edges JOIN v a ON a.id = src JOIN v b ON b.id = dst""")
def k07(i):
    return render.ascii_lines(*_flow(i), verbosity=2)


@query("k08_ascii_plain", f"{FL}, {_num} SELECT 0 AS part, lpad(CAST(n AS VARCHAR), 12, '0') AS key, 'N' || n || ' [' || {_label} || ']' AS line FROM v UNION ALL SELECT 1, {_key}, 'N' || a.n || ' -> N' || b.n || ' (' || edge_type || ')' FROM edges JOIN v a ON a.id = src JOIN v b ON b.id = dst")
def k08(i):
    return render.ascii_lines(*_flow(i))


_head = lambda columns: "'| " + " | ".join(columns) + " |' || chr(10) || '|" + " --- |" * len(columns) + "'"
_two = lambda c: f"coalesce(printf('%.2f', {c}), 'None')"
_when = "strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN extract('microseconds' FROM ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END"
_part = lambda title, body: f"'## {title}' || repeat(chr(10), 2) || {body} || repeat(chr(10), 2)"


def _listing(columns, rows, order, cells, most=50):
    """A Markdown table of a branch's first rows."""
    line = "'| ' || " + " || ' | ' || ".join(cells) + " || ' |'"
    return f"{_head(columns)} || coalesce((SELECT chr(10) || string_agg({line}, chr(10) ORDER BY place) FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY {order}) AS place FROM ({rows})) x WHERE x.branch = b.branch AND place <= {most}), '')"


_body = lambda key: ORACLES[key].removeprefix(f"{S}, {_rates}").lstrip(", ")
_series = "s AS (SELECT branch, debt AS v, row_number() OVER (PARTITION BY branch ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY branch) AS n, max(debt) OVER (PARTITION BY branch) AS top FROM snapshots), cells AS (SELECT branch, v, top, j FROM s, range(50) t(j) WHERE CASE WHEN n <= 50 THEN j = i ELSE floor(j * n / 50) = i END), bars AS (SELECT branch, CAST(k AS INTEGER) AS row, string_agg(CASE WHEN v >= top * (10 - k) / 10 THEN '#' ELSE ' ' END, '' ORDER BY j) AS line FROM cells, range(11) t(k) GROUP BY ALL)"
_odd = "odd AS (SELECT branch, ts, 'debt' AS metric, debt AS value, dm AS expected FROM w WHERE k >= 3 AND abs(debt - dm) > 0.5 * dm UNION ALL SELECT branch, ts, 'complexity', complexity, cm FROM w WHERE k >= 3 AND abs(complexity - cm) > 0.4 * cm)"
_walk = "w AS (SELECT *, row_number() OVER o AS k, avg(debt) OVER (PARTITION BY branch ORDER BY ts, commit_hash ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS dm, avg(complexity) OVER (PARTITION BY branch ORDER BY ts, commit_hash ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS cm FROM snapshots WINDOW o AS (PARTITION BY branch ORDER BY ts, commit_hash))"


@query(
    "k10_report",
    f"""{S}, {_rates}, overall AS (WITH {_body('t06_overall')}), findings AS (WITH {_body('t07_findings')}), advice AS ({_body('t08_advice')}), ahead AS (WITH {_body('t09_predict')}), {_walk}, {_odd}, {_series}
SELECT branch, '# Quality of ' || branch || repeat(chr(10), 2) || {_part('Overview', "(SELECT count(*) FROM snapshots x WHERE x.branch = b.branch) || ' snapshots'")} || {_part('Overall trend', "coalesce((SELECT overall FROM overall x WHERE x.branch = b.branch), 'too few snapshots')")}
  || {_part('Trends', _listing(['metric', 'first', 'last', 'rate', 'direction'], 'SELECT * FROM rates', 'metric', ['metric', _two('first'), _two('last'), _two('rate'), 'direction']))}
  || {_part('Findings', _listing(['finding', 'value'], 'SELECT * FROM findings', 'finding', ['finding', _two('value')]))} || {_part('Advice', _listing(['metric', 'advice'], 'SELECT * FROM advice', 'metric', ['metric', 'advice']))}
  || {_part('Prediction', _listing(['days_to_critical', 'next_complexity', 'confidence'], 'SELECT * FROM ahead', 'branch', ["coalesce(CAST(days_to_critical AS VARCHAR), 'None')", _two('next_complexity'), 'confidence']))}
  || {_part('Anomalies', _listing(['ts', 'metric', 'value', 'expected'], 'SELECT * FROM odd', 'ts, metric', [_when, 'metric', _two('value'), _two('expected')]))}
  || {_part('Debt', "'```' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY row) FROM bars x WHERE x.branch = b.branch) || chr(10) || '```'")}
  || '## History' || repeat(chr(10), 2) || {_listing(['ts', 'commit_hash', 'debt', 'complexity', 'stability'], 'SELECT * FROM snapshots', 'ts DESC, commit_hash DESC', [_when, 'commit_hash', _two('debt'), _two('complexity'), _two('stability')], 20)} || chr(10) AS report
FROM (VALUES ('click'), ('error')) b(branch)""",
)
def k10(i):
    s = i.bind("snapshots")
    return i.spark.createDataFrame([(b, render.trend_report(s, b)) for b in ("click", "error")], "branch string, report string")


@query("k11_bars", f"""WITH {ctes('snapshots')}, s AS (SELECT branch, debt AS v, row_number() OVER (PARTITION BY branch ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY branch) AS n, max(debt) OVER (PARTITION BY branch) AS top FROM snapshots),
c AS (SELECT branch, v, top, j FROM s, range(20) t(j) WHERE CASE WHEN n <= 20 THEN j = i ELSE floor(j * n / 20) = i END), r AS (SELECT c.*, CAST(k AS INTEGER) AS row FROM c, range(11) t(k))
SELECT branch, row, string_agg(CASE WHEN v >= top * (10 - row) / 10 THEN '#' ELSE ' ' END, '' ORDER BY j) AS line FROM r GROUP BY ALL""")
def k11(i):
    return render.bar_chart(i.bind("snapshots"), "branch", "ts", "debt", width=20)


_plain = f"{FL}, {_num}, l AS (SELECT 0 AS part, lpad(CAST(n AS VARCHAR), 12, '0') AS key, 'N' || n || ' [' || {_label} || ']' AS line FROM v UNION ALL SELECT 1, {_key}, 'N' || a.n || ' -> N' || b.n || ' (' || edge_type || ')' FROM edges JOIN v a ON a.id = src JOIN v b ON b.id = dst)"
_escaped = "replace(replace(replace(replace(replace(string_agg(line, chr(10) ORDER BY part, key), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


@query("k12_html", f"{_plain} SELECT '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset=' || chr(39) || 'utf-8' || chr(39) || '><title>Graph</title></head><body><pre>' || {_escaped} || '</pre></body></html>' AS html FROM l")
def k12(i):
    return i.spark.createDataFrame([(render.html_page("Graph", render.document(render.ascii_lines(*_flow(i)))),)], "html string")


_supp = _propagation(3, "id = 'supp:1'")
_rows = lambda cond, line: f"coalesce((SELECT string_agg({line}, chr(10) ORDER BY score DESC, id) FROM (SELECT * FROM imp WHERE {cond} ORDER BY score DESC, id LIMIT 10)), '')"


@query("k13_impact_report", f"""{_supp}, best AS (SELECT id FROM imp ORDER BY score DESC, id LIMIT 5),
w(source, path, weight, k) AS (SELECT id, [id], CAST(1 AS DOUBLE), 0 FROM vertices WHERE id = 'supp:1' UNION SELECT source, list_append(path, to_), w.weight * factor * CAST(0.9 AS DOUBLE), k + 1 FROM w JOIN st ON at_ = path[-1] WHERE k < 2 AND NOT list_contains(path, to_)),
m AS (SELECT *, row_number() OVER (PARTITION BY source, path[-1] ORDER BY k, path) AS r FROM w WHERE k > 0),
ways AS (SELECT source, path[-1] AS target, path, weight FROM m WHERE r = 1 AND path[-1] IN (FROM best) AND weight > 0.4 ORDER BY weight DESC, source, target LIMIT 5),
n AS (SELECT least(count(*) FILTER (WHERE depth = 1), 10) AS direct, least(count(*) FILTER (WHERE depth > 1), 10) AS rest FROM imp)
SELECT '# Impact' || repeat(chr(10), 2) || 'Direct:' || repeat(chr(10), 2) || {_head(['id', 'score'])} || CASE WHEN direct > 0 THEN chr(10) ELSE '' END || {_rows('depth = 1', "'| ' || id || ' | ' || printf('%.2f', score) || ' |'")} || repeat(chr(10), 2) || 'Indirect:' || repeat(chr(10), 2) || {_head(['id', 'score', 'depth'])} || CASE WHEN rest > 0 THEN chr(10) ELSE '' END || {_rows('depth > 1', "'| ' || id || ' | ' || printf('%.2f', score) || ' | ' || depth || ' |'")}
  || repeat(chr(10), 2) || 'Paths:' || repeat(chr(10), 2) || coalesce((SELECT string_agg('* ' || array_to_string(path, ' > '), chr(10) ORDER BY weight DESC, source, target) FROM ways), '') || repeat(chr(10), 2) || 'Advice: ' || CASE WHEN direct + rest >= 10 THEN 'split the change' WHEN direct > 0 THEN 'run the tests of the impacted parts' ELSE 'no impact found' END AS report FROM n""")
def k13(i):
    v, e = i.trade
    found = impact.propagate(v, e, v.where("id = 'supp:1'"))
    ways = impact.critical_paths(v, e, v.where("id = 'supp:1'"), found, least=0.4)
    return i.spark.createDataFrame([(render.impact_report(found, ways),)], "report string")


_levels = "r AS (SELECT *, " + sql_case("change_type", CHANGE_RISK) + " AS risk, row_number() OVER (PARTITION BY " + sql_case("change_type", CHANGE_RISK) + " ORDER BY change_id) AS place FROM changes), l AS (SELECT risk, " + sql_case("risk", {"Critical": 1, "High": 2, "Medium": 3, "Low": 4}) + " AS level, '## ' || risk || ' (' || count(*) || ')' || chr(10) || string_agg('* ' || change_type || ': ' || component, chr(10) ORDER BY change_id) AS text FROM r WHERE place <= 200 AND risk IS NOT NULL GROUP BY risk)"


@query("k14_change_report", f"WITH {ctes('changes')}, {_levels} SELECT condensed, coalesce(string_agg(text, repeat(chr(10), 2) ORDER BY level), 'no changes') AS report FROM l, (VALUES (false), (true)) c(condensed) WHERE NOT condensed OR level <= 2 GROUP BY condensed")
def k14(i):
    c = rules.change_risk(i.bind("changes"))
    return i.spark.createDataFrame([(False, render.change_report(c)), (True, render.change_report(c, condensed=True))], "condensed boolean, report string")


@query("k15_insight_report", f"WITH {ctes('functions', 'classes')}, spots AS (SELECT name, ord, CAST(line_end - line_start + 5 * n_params AS DOUBLE) AS score FROM functions WHERE n_params > 5 OR line_end - line_start > 50 ORDER BY score DESC, name, ord LIMIT 10) SELECT '# Insights' || repeat(chr(10), 2) || 'Hotspots:' || repeat(chr(10), 2) || {_head(['name', 'score'])} || chr(10) || (SELECT string_agg('| ' || name || ' | ' || printf('%.2f', score) || ' |', chr(10) ORDER BY score DESC, name, ord) FROM spots) || repeat(chr(10), 2) || 'Violations: ' || ((SELECT count(*) FROM classes WHERE n_methods > 20) + (SELECT count(*) FROM functions WHERE line_end - line_start > 50)) || repeat(chr(10), 2) || 'Public functions: ' || (SELECT count(*) FROM functions WHERE visibility = 'public') AS report")
def k15(i):
    f, c = i.bind("functions"), i.bind("classes")
    return i.spark.createDataFrame([(render.insight_report(rules.hotspots(f), rules.pattern_violations(f, c), rules.public_api(f)),)], "report string")


@query("k16_template", "SELECT p_partkey, 'part ' || p_partkey || ' of ' || p_brand || ' and {other}' AS text FROM part")
def k16(i):
    return i.table("part").select("p_partkey", render.template(F.lit("part {key} of {brand} and {other}"), {"key": F.col("p_partkey").cast("string"), "brand": F.col("p_brand")}).alias("text"))


@query("g23_budget")
def g23(i):
    sizes = lambda p: {"seeds": p.seeds, "top": p.top, "kept": 5000 if p.radius > 1 else 500, "communities": p.communities, "community_edges": 2 * p.communities, "path_nodes": 4 * p.paths}
    plans = [(t, *summary.fit_budget(summary.Plan(2, 300, 10, 5, 20), t, sizes).__dict__.values()) for t in (0, 10, 3000, 100000)]
    return i.spark.createDataFrame(plans, "tokens long, radius int, top int, communities int, paths int, seeds int, truncated boolean")


@query("g24_summary")
def g24(i):
    v, e = i.bind("web_vertices"), i.bind("web_edges")
    return summary.as_rows(*summary.graph_summary(v, e, i.spark.createDataFrame([("page:1",)], "path string")))
