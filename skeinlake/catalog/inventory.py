"""Settings, guards, budgets and fixed answers: what the engine says about itself, as tables."""

from pathlib import Path

from pyspark.sql import functions as F

from ..operators import build, ops, rules, summary
from ..sources import config
from .bindings import ctes
from .graphs import W, _lp, _pagerank_sql
from .registry import query

_settings = Path(__file__).parent / "samples" / "settings.toml"


@query("s21_settings", "SELECT * FROM (VALUES ('default', 'temperature', 0.3::DOUBLE), ('default', 'timeout_seconds', 300), ('default', 'top_k', 200), ('default', 'radius', 2), ('default', 'budget_tokens', 3000), ('default', 'damping', 0.85), ('review', 'temperature', 0.7), ('review', 'timeout_seconds', 300), ('review', 'top_k', 50), ('review', 'radius', 2), ('review', 'budget_tokens', 3000), ('review', 'damping', 0.85), ('broken', 'refused', 1)) s(section, setting, value)")
def s21(i):
    """Settings by default, those of a section of a file, and whether a section out of range is refused."""
    rows = [(name, k, float(v)) for name, s in (("default", config.Settings()), ("review", config.load(str(_settings), "review"))) for k, v in vars(s).items()]
    try:
        config.load(str(_settings), "broken")
        refused = 0.0
    except ValueError:
        refused = 1.0
    return i.spark.createDataFrame([*rows, ("broken", "refused", refused)], "section string, setting string, value double")


@query("b10_guard", "SELECT 'part' AS files, count(*) > 1500 AS refused FROM part UNION ALL SELECT 'supplier', count(*) > 1500 FROM supplier UNION ALL SELECT 'part, confirmed', false")
def b10(i):
    def refused(table, confirmed=False):
        try:
            build.guard_size(i.table(table), confirmed=confirmed)
        except ValueError:
            return True
        return False

    return i.spark.createDataFrame([("part", refused("part")), ("supplier", refused("supplier")), ("part, confirmed", refused("part", True))], "files string, refused boolean")


_cost = "400 + 40 * seeds + 60 * top + 8 * CASE WHEN radius > 1 THEN wide ELSE near END + 80 * communities + 100 * communities + 120 * paths"
_step = f"{_cost} > greatest(4 * tokens, 2000) AND tokens > 0 AND step < 8"
_cut = ("radius > 1 AND NOT reduced", "top > 150", "communities > 5", "paths > 3", "seeds > 10")


def _cuts(column, value, k):
    """A plan's part after a step: cut if the first k conditions fail and this one holds."""
    before = " AND ".join(f"NOT ({c})" for c in _cut[:k])
    return f"CASE WHEN {before + ' AND ' if before else ''}({_cut[k]}) THEN {value} ELSE {column} END AS {column}"


@query(
    "g23_budget_steps",
    f"""WITH RECURSIVE {ctes('web_vertices')}, s AS (SELECT count(*) AS wide, count(*) FILTER (WHERE node_type = 'File') AS near FROM web_vertices),
p(tokens, step, radius, top, communities, paths, seeds, truncated, reduced, wide, near) AS (SELECT tokens, 0, 2, 300, 10, 5, 20, false, false, wide, near FROM s, (VALUES (0), (10), (3000), (6500), (100000)) t(tokens)
UNION ALL SELECT tokens, step + 1, {_cuts('radius', '1', 0)}, {_cuts('top', '150', 1)}, {_cuts('communities', '5', 2)}, {_cuts('paths', '3', 3)}, {_cuts('seeds', '10', 4)}, truncated OR {' OR '.join(f'({c})' for c in _cut)}, reduced OR radius > 1, wide, near FROM p WHERE {_step})
SELECT CAST(tokens AS BIGINT) AS tokens, radius, top, communities, paths, seeds, truncated FROM p QUALIFY row_number() OVER (PARTITION BY tokens ORDER BY step DESC) = 1""",
)
def g23b(i):
    """The plans that fit budgets, where the kept nodes are all of the web graph beyond radius 1 and its pages within."""
    counts = i.bind("web_vertices").agg(F.count("*"), F.count_if(F.col("node_type") == "File")).first()
    sizes = lambda p: {"seeds": p.seeds, "top": p.top, "kept": counts[0] if p.radius > 1 else counts[1], "communities": p.communities, "community_edges": 2 * p.communities, "path_nodes": 4 * p.paths}
    plans = [(t, *summary.fit_budget(summary.Plan(2, 300, 10, 5, 20), t, sizes).__dict__.values()) for t in (0, 10, 3000, 6500, 100000)]
    return i.spark.createDataFrame(plans, "tokens long, radius int, top int, communities int, paths int, seeds int, truncated boolean")


_near = "b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), reach(id, depth) AS (SELECT id, 0 FROM vertices WHERE id = 'page:1' UNION SELECT b.dst, depth + 1 FROM reach JOIN b ON b.src = reach.id WHERE depth < 2), kept AS (SELECT DISTINCT id FROM reach)"


@query(
    "g24_sections",
    f"""{_pagerank_sql(W)}, {_lp.partition(W)[2].lstrip(', ').replace('b AS MATERIALIZED', 'ends AS MATERIALIZED').replace('FROM b JOIN', 'FROM ends b JOIN')}, {_near},
c AS (SELECT label, count(*) AS size FROM l10 GROUP BY label ORDER BY size DESC, label LIMIT 10),
m AS (SELECT label, size, id, row_number() OVER (PARTITION BY label ORDER BY importance DESC, id) AS place FROM l10 JOIN c USING (label) JOIN vertices USING (id)),
x AS (SELECT a.label AS x, b.label AS y, count(*) AS n FROM edges JOIN l10 a ON a.id = src JOIN l10 b ON b.id = dst WHERE a.label <> b.label GROUP BY ALL ORDER BY n DESC, x, y LIMIT 20)
SELECT * FROM (SELECT 'top' AS section, id AS item, round(r, 9) AS value FROM ranks WHERE id IN (FROM kept) ORDER BY r DESC, id LIMIT 200)
UNION ALL SELECT 'seeds', 'page:1', NULL UNION ALL SELECT 'statistics', 'n_nodes', count(*) FROM vertices UNION ALL SELECT 'statistics', 'n_edges', count(*) FROM edges
UNION ALL SELECT 'communities', label || ' > ' || id, size FROM m WHERE place <= 5 UNION ALL SELECT 'community_edges', x || ' > ' || y, n FROM x""",
)
def g24s(i):
    """The parts of the graph summary with its default rounds, a row for each item. The SQL has whole parts, so no budget cuts them; g23_budget_steps has the cuts."""
    v, e = i.bind("web_vertices"), i.bind("web_edges")
    parts, _ = summary.graph_summary(v, e, i.spark.createDataFrame([("page:1",)], "path string"), tokens=0)
    row = lambda section, df, item, value: df.select(F.lit(section).alias("section"), item.alias("item"), value.cast("double").alias("value"))
    pair = lambda a, b: F.concat(F.col(a), F.lit(" > "), F.col(b))
    out = row("top", parts["top"], F.col("id"), F.round("pagerank", 9)).unionByName(row("seeds", parts["seeds"], F.col("id"), F.lit(None)))
    for name in ("n_nodes", "n_edges"):
        out = out.unionByName(row("statistics", parts["statistics"], F.lit(name), F.col(name)))
    out = out.unionByName(row("communities", parts["communities"], pair("label", "id"), F.col("size")))
    out = out.unionByName(row("community_edges", parts["community_edges"], pair("from_label", "to_label"), F.col("n")))
    return out.unionByName(row("paths", parts["paths"], F.col("path"), F.lit(None)))


@query("d16_stubs", "SELECT CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS problem WHERE false")
def d16(i):
    """Detectors that the original leaves empty: no rows, of the shape of the others'."""
    return rules.undetected(i.spark)


@query("r12_layers", "SELECT 'Domain' AS layer, 'Infrastructure' AS allowed, 0.3::DOUBLE AS average_coupling")
def r12(i):
    return rules.layers(i.spark)


@query("r24_deviation", f"WITH {ctes('findings')} SELECT target, count(*) AS matched, CAST(50 AS INTEGER) AS match_score, false AS needs_attention FROM findings GROUP BY target")
def r24(i):
    return rules.deviation(i.bind("findings"), "target")


@query("c12_backoff", "SELECT event_id, CAST(k AS INTEGER) AS attempt, CAST(pow(2, k - 1) AS BIGINT) AS wait_seconds, ts + to_seconds(CAST(pow(2, k) AS BIGINT) - 1) AS at FROM events, range(1, 4) t(k) WHERE event_type = 'error'")
def c12(i):
    return ops.retries(i.table("events").where("event_type = 'error'"), "ts").select("event_id", "attempt", "wait_seconds", "at")


@query("c13_resolutions", "SELECT event_type AS service, count(*) AS resolved, count(*) - 1 AS from_cache, CAST(1 AS BIGINT) AS created, round((count(*) - 1) / count(*), 9) AS hit_rate FROM events GROUP BY 1")
def c13(i):
    return ops.resolutions(i.table("events").select(F.col("event_type").alias("service"))).withColumn("hit_rate", F.round("hit_rate", 9))


@query("c15_features", "SELECT * FROM (VALUES ('core', 1, 1), ('analysis', 6, 6), ('language', 8, 8), ('streaming', 1, 1), ('text corpus', 1, 0)) f(category, total, always)")
def c15(i):
    return ops.features(i.spark)
