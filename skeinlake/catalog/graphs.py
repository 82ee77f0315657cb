"""B, G and P: graph build, analytics, impact."""

from pyspark.sql import functions as F

from ..functions.lookups import EDGE_FACTORS, TYPE_FACTORS, sql_case
from ..operators import build, graph, impact
from .bindings import ctes
from .registry import query

T = f"WITH RECURSIVE {ctes('trade_vertices', 'trade_edges')}, vertices AS (SELECT * FROM trade_vertices), edges AS (SELECT * FROM trade_edges)"
W = f"WITH RECURSIVE {ctes('web_vertices', 'web_edges')}, vertices AS (SELECT * FROM web_vertices), edges AS (SELECT * FROM web_edges)"
FL = f"WITH RECURSIVE {ctes('flow_vertices', 'flow_edges')}, vertices AS (SELECT * FROM flow_vertices), edges AS (SELECT * FROM flow_edges)"
FN = f"WITH {ctes('functions', 'classes', 'calls')}"
_fid = lambda p, n: f"'func:' || {p} || '::' || {n}"


def _web(i):
    return i.bind("web_vertices"), i.bind("web_edges")


M = f"WITH RECURSIVE {ctes('mesh_vertices', 'mesh_edges')}, vertices AS (SELECT * FROM mesh_vertices), edges AS (SELECT * FROM mesh_edges)"


def _flow(i):
    return i.bind("flow_vertices"), i.bind("flow_edges")


def _mesh(i):
    return i.bind("mesh_vertices"), i.bind("mesh_edges")


_imp_f = "least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) + CASE WHEN visibility = 'public' THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CASE WHEN is_async THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CAST(0.02 AS DOUBLE) * n_params)"
_imp_c = "least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) + CASE WHEN is_abstract THEN CAST(0.15 AS DOUBLE) ELSE 0 END + CASE WHEN extends IS NOT NULL THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CAST(0.05 AS DOUBLE) * n_implements + CAST(0.01 AS DOUBLE) * n_methods)"
_enc = "enc AS (SELECT call_id, c.file_path, callee, line, min_by(f.name, f.ord) AS caller FROM calls c JOIN functions f ON c.file_path = f.file_path AND line BETWEEN line_start AND line_end GROUP BY ALL)"
_same = f"same AS (SELECT {_fid('e.file_path', 'caller')} AS src, {_fid('e.file_path', 'callee')} AS dst, call_id FROM enc e SEMI JOIN functions f ON e.file_path = f.file_path AND e.callee = f.name)"
_uniq = f"uniq AS (SELECT name, min(id) AS id FROM (SELECT DISTINCT name, {_fid('file_path', 'name')} AS id FROM functions) GROUP BY name HAVING count(*) = 1)"
_imports = "imports AS (SELECT 'cust:' || o_custkey AS file_path, o_orderpriority AS name FROM orders WHERE o_orderkey % 50 = 0), exports AS (SELECT 'cust:' || o_custkey AS file_path, 'f' || o_orderkey % 997 AS name FROM orders WHERE o_orderkey % 40 = 0 UNION ALL SELECT file_path, name FROM classes)"


def _extras(i):
    o = i.table("orders")
    path = F.concat(F.lit("cust:"), F.col("o_custkey").cast("string"))
    exports = o.where("o_orderkey % 40 = 0").select(path.alias("file_path"), F.concat(F.lit("f"), (F.col("o_orderkey") % 997).cast("string")).alias("name")).unionByName(i.bind("classes").select("file_path", "name"))
    return o.where("o_orderkey % 50 = 0").select(path.alias("file_path"), F.col("o_orderpriority").alias("name")), exports


@query(
    "b01_build",
    f"""{FN}, {_imports}, {_enc}, {_same}, e AS (SELECT 'file:' || file_path AS src, {_fid('file_path', 'name')} AS dst, 'Contains' AS edge_type, CAST(1 AS DOUBLE) AS weight FROM functions UNION ALL SELECT 'file:' || file_path, 'class:' || file_path || '::' || name, 'Contains', 1 FROM classes
UNION ALL SELECT 'file:' || file_path, 'module:' || name, 'Imports', 0.8 FROM imports UNION ALL SELECT 'file:' || x.file_path, CASE WHEN EXISTS (FROM functions f WHERE f.file_path = x.file_path AND f.name = x.name) THEN {_fid('x.file_path', 'x.name')} ELSE 'class:' || x.file_path || '::' || x.name END, 'Exports', 0.9 FROM exports x
  WHERE EXISTS (FROM functions f WHERE f.file_path = x.file_path AND f.name = x.name) OR EXISTS (FROM classes f WHERE f.file_path = x.file_path AND f.name = x.name)
UNION ALL SELECT src, dst, 'Calls', 1 FROM same) SELECT src, dst, edge_type, weight, count(*) AS n FROM e GROUP BY ALL""",
)
def b01(i):
    imports, exports = _extras(i)
    return build.file_edges(i.bind("functions"), i.bind("classes"), imports, exports, i.bind("calls")).groupBy("src", "dst", "edge_type", "weight").agg(F.count("*").alias("n"))


@query("b02_rangejoin", f"{FN}, {_enc} SELECT * FROM enc")
def b02(i):
    return build.enclosing(i.bind("calls"), i.bind("functions"))


@query("b03_same_file", f"{FN}, {_enc}, {_same} SELECT * FROM same")
def b03(i):
    return build.same_file_calls(i.bind("calls"), i.bind("functions"))


@query("b04_unique", f"{FN}, {_enc}, {_uniq} SELECT {_fid('file_path', 'caller')} AS src, id AS dst, call_id FROM enc JOIN uniq ON callee = uniq.name")
def b04(i):
    return build.resolved_calls(i.bind("calls"), i.bind("functions"))


_nodes = f"""nodes AS (SELECT DISTINCT 'file:' || file_path AS id, 'File' AS node_type, CAST(0.5 AS DOUBLE) AS importance, CAST(-1 AS BIGINT) AS ord FROM (SELECT file_path FROM functions UNION SELECT file_path FROM classes)
UNION ALL SELECT {_fid('file_path', 'name')}, 'Function', {_imp_f}, ord FROM functions UNION ALL SELECT 'class:' || file_path || '::' || name, 'Class', {_imp_c}, ord FROM classes)"""


@query("b05_keepfirst", f"{FN}, {_nodes} SELECT id, node_type, round(importance, 6) AS importance FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1")
def b05(i):
    return build.global_graph(i.bind("functions"), i.bind("classes"), i.bind("calls"))[0].select("id", "node_type", F.round("importance", 6).alias("importance"))


@query("b05_calls", f"{FN}, {_enc}, {_same}, {_uniq} SELECT * FROM same UNION SELECT {_fid('file_path', 'caller')} AS src, id AS dst, call_id FROM enc JOIN uniq ON callee = uniq.name")
def b05c(i):
    return build.global_graph(i.bind("functions"), i.bind("classes"), i.bind("calls"))[1]


@query("b06_keeplast", f"{FN}, {_nodes} SELECT id, node_type, round(importance, 6) AS importance FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1")
def b06(i):
    return build.keep_first(build.vertices(i.bind("functions"), i.bind("classes")), last=True).select("id", "node_type", F.round("importance", 6).alias("importance"))


@query("b07_importance", f"{FN}, {_nodes} SELECT node_type, count(*) AS n, round(sum(importance), 6) AS total FROM nodes GROUP BY node_type")
def b07(i):
    return build.vertices(i.bind("functions"), i.bind("classes")).groupBy("node_type").agg(F.count("*").alias("n"), F.round(F.sum("importance"), 6).alias("total"))


@query("b08_display_name", "SELECT page_id, regexp_split_to_array(url, '[./:]')[-1] AS name FROM pages")
def b08(i):
    return i.table("pages").select("page_id", build.display_name(F.col("url")).alias("name"))


@query("b09_inheritance", f"{FN} SELECT name AS src, extends AS dst FROM classes WHERE extends IS NOT NULL")
def b09(i):
    return build.inheritance(i.bind("classes"))


@query("g01_neighbors", f"{T} SELECT dst AS id, 'dependency' AS relation FROM edges WHERE src = 'nation:3' UNION ALL SELECT src, 'dependent' FROM edges WHERE dst = 'nation:3'")
def g01(i):
    return graph.neighbours(i.trade[1], "nation:3")


@query("g02_adjacency", f"{FL} SELECT src AS id, list(dst ORDER BY dst) AS targets FROM edges GROUP BY src")
def g02(i):
    return graph.adjacency(_flow(i)[1])


@query("g02_adjacency_trade", f"{T} SELECT src AS id, list(dst ORDER BY dst) AS targets FROM edges GROUP BY src")
def g02m(i):
    return graph.adjacency(i.trade[1])


@query("g03_scope", f"{T}, r(id, depth) AS (SELECT 'supp:1', 0 UNION SELECT src, depth + 1 FROM r JOIN edges ON dst = r.id WHERE depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def g03(i):
    return graph.reach(i.trade[1], i.trade[0].where("id = 'supp:1'"), 3)


@query("g04_neighborhood", f"{W}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r(id, depth) AS (SELECT id, 0 FROM vertices WHERE id IN ('page:1', 'page:2') UNION SELECT b.dst, depth + 1 FROM r JOIN b ON b.src = r.id WHERE depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def g04(i):
    v, e = _web(i)
    return graph.neighbourhood(e, v.where("id in ('page:1', 'page:2')"), 2)


_deg = "n AS (SELECT count(*) AS n FROM vertices), deg AS (SELECT id, (SELECT count(*) FROM edges WHERE dst = id) AS fan_in, (SELECT count(*) FROM edges WHERE src = id) AS fan_out FROM vertices), cen AS (SELECT id, fan_in, fan_out, (fan_in + fan_out) / (2 * n) AS centrality FROM deg, n)"


@query("g05_degree", f"{T}, {_deg} SELECT id, fan_in, fan_out, round(centrality, 9) AS centrality FROM cen")
def g05(i):
    return graph.degrees(*i.trade).withColumn("centrality", F.round("centrality", 9))


@query("g07_critical", f"{T}, {_deg} SELECT id, round(centrality, 9) AS centrality FROM cen WHERE centrality > 0.02")
def g07(i):
    return graph.critical(*i.trade, 0.02).select("id", F.round("centrality", 9).alias("centrality"))


@query("g08_fan", f"{W}, {_deg} SELECT id, fan_in, fan_out FROM cen WHERE centrality >= 0.01")
def g08(i):
    return graph.critical(*_web(i), 0.01, inclusive=True).select("id", "fan_in", "fan_out")


@query("g09_stats", f"{T}, {_deg}, k AS (SELECT id FROM vertices WHERE id NOT LIKE 'nation:1%'), x AS (SELECT count(*) AS e FROM edges WHERE src IN (FROM k) AND dst IN (FROM k)), kn AS (SELECT count(*) AS n FROM k) SELECT kn.n AS n_nodes, e AS n_edges, round(2 * e / kn.n, 9) AS avg_degree, (SELECT count(*) FROM (SELECT (SELECT count(*) FROM edges WHERE src = k.id OR dst = k.id) / (2 * (SELECT n FROM kn)) AS c FROM k) WHERE c > 0.02) AS n_critical FROM x, kn")
def g09(i):
    v, e = i.trade
    return graph.statistics(v.where("id not like 'nation:1%'"), e, 0.02).withColumn("avg_degree", F.round("avg_degree", 9))


@query("g10_oncycle", f"{FL}, c(src, dst) AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM c JOIN edges e ON c.dst = e.src) SELECT src AS id FROM c WHERE src = dst")
def g10(i):
    return graph.on_cycles(_flow(i)[1])


@query("g10_oncycle_mesh", f"{M}, p AS (SELECT DISTINCT src, dst FROM edges WHERE src NOT LIKE '%7' AND dst <> 'm:12'), c(src, dst) AS (SELECT src, dst FROM p UNION SELECT c.src, p.dst FROM c JOIN p ON c.dst = p.src) SELECT src AS id FROM c WHERE src = dst")
def g10m(i):
    return graph.on_cycles(_mesh(i)[1].where("src not like '%7' and dst <> 'm:12'"))


@query("g11_inheritance_cycles", f"WITH RECURSIVE e AS (SELECT DISTINCT 'c' || s_suppkey % 9 AS src, 'c' || s_suppkey % 4 AS dst FROM supplier WHERE s_suppkey % 9 <> s_suppkey % 4), c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src AS id FROM c WHERE src = dst")
def g11(i):
    s = F.col("s_suppkey")
    e = i.table("supplier").select(F.concat(F.lit("c"), (s % 9).cast("string")).alias("name"), F.concat(F.lit("c"), (s % 4).cast("string")).alias("extends")).where("name <> extends")
    return graph.on_cycles(build.inheritance(e))


@query("g12_registry_cycles", f"WITH RECURSIVE {ctes('requirements')}, e AS (SELECT service AS src, needs AS dst FROM requirements UNION SELECT 's1', 's5'), c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src AS id FROM c WHERE src = dst")
def g12(i):
    e = i.bind("requirements").select(F.col("service").alias("src"), F.col("needs").alias("dst"))
    return graph.on_cycles(e.union(i.spark.createDataFrame([("s1", "s5")], "src string, dst string")))


@query("g13_levels", f"{T}, p AS (SELECT DISTINCT src, dst FROM edges), r(id, level) AS (SELECT id, 0 FROM vertices UNION SELECT dst, level + 1 FROM r JOIN p ON p.src = r.id) SELECT id, max(level) AS level FROM r GROUP BY id")
def g13(i):
    return graph.levels(*i.trade)


@query("g14_weighted", f"""{T}, f AS (SELECT src, dst, min_by(weight, pos) AS w FROM edges GROUP BY ALL), s AS (SELECT e.dst AS at_, e.src AS to_, coalesce(f.w, 1) * coalesce(v.importance, 0.5) * CAST(0.85 AS DOUBLE) AS factor FROM (SELECT DISTINCT src, dst FROM edges) e LEFT JOIN f ON f.src = e.dst AND f.dst = e.src LEFT JOIN vertices v ON v.id = e.src),
r(id, score, k) AS (SELECT 'supp:1', CAST(1 AS DOUBLE), 0 UNION SELECT to_, score * factor, k + 1 FROM r JOIN s ON s.at_ = r.id WHERE score * factor >= 0.05 AND k < 8) SELECT id, round(max(score), 9) AS score FROM r GROUP BY id""")
def g14(i):
    v, e = i.trade
    return graph.weighted_impact(v, e, v.where("id = 'supp:1'")).withColumn("score", F.round("score", 9))


def _pagerank_sql(head, rounds=20, tolerance=1e-6):
    """CTEs of all rounds, and `ranks`: those of the first round but one after which ranks move by less than the tolerance, or of the last."""
    out = f"{head}, n AS (SELECT count(*) AS n FROM vertices), o AS (SELECT src, count(*) AS out FROM edges GROUP BY src), f AS (SELECT src, dst, min_by(weight, pos) AS w FROM edges GROUP BY ALL), l AS MATERIALIZED (SELECT e.src, e.dst, f.w / o.out AS share FROM edges e JOIN f USING (src, dst) JOIN o USING (src)), r0 AS MATERIALIZED (SELECT id, CAST(1 AS DOUBLE) / n AS r FROM vertices, n)"
    for k in range(rounds):
        out += f""", g{k} AS (SELECT dst, sum(r * share) AS got FROM r{k} JOIN l ON id = src GROUP BY dst), d{k} AS (SELECT coalesce(sum(r), 0) AS lost FROM r{k} WHERE id NOT IN (SELECT src FROM l)),
r{k + 1} AS MATERIALIZED (SELECT id, CAST(0.15 AS DOUBLE) / n + CAST(0.85 AS DOUBLE) * coalesce(got, 0) + CAST(0.85 AS DOUBLE) * lost / n AS r FROM vertices LEFT JOIN g{k} ON id = dst, n, d{k})"""
    moved = " UNION ALL ".join(f"SELECT {k + 1} AS k, sum(abs(a.r - b.r)) AS moved FROM r{k + 1} a JOIN r{k} b USING (id)" for k in range(1, rounds))
    every = " UNION ALL ".join(f"SELECT {k} AS k, id, r FROM r{k}" for k in range(2, rounds + 1))
    return out + f", stop AS (SELECT coalesce(min(k) FILTER (WHERE moved < {tolerance!r}), {rounds}) AS k FROM ({moved})), ranks AS (SELECT id, r FROM ({every}) WHERE k = (SELECT k FROM stop))"


_pr = _pagerank_sql(T)


@query("g06_pagerank", f"{_pr} SELECT id, round(r, 9) AS pagerank FROM ranks")
def g06(i):
    return graph.pagerank(*i.trade).withColumn("pagerank", F.round("pagerank", 9))


@query("g06_early_stop", f"{_pagerank_sql(T, tolerance=1e-3)} SELECT id, round(r, 9) AS pagerank FROM ranks")
def g06b(i):
    return graph.pagerank(*i.trade, tolerance=1e-3).withColumn("pagerank", F.round("pagerank", 9))


@query("g22_topk", f"{_pr} SELECT id, round(r, 9) AS pagerank FROM ranks WHERE id LIKE 'supp:%' ORDER BY round(r, 9) DESC, id LIMIT 20")
def g22(i):
    v, e = i.trade
    return graph.top_ranked(graph.pagerank(v, e).withColumn("pagerank", F.round("pagerank", 9)), v.where("id like 'supp:%'"), 20)


_lp = f"{W}, b AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges UNION SELECT id, id FROM vertices), l0 AS (SELECT id, id AS label FROM vertices)" + "".join(f", v{k} AS (SELECT a AS id, label, count(*) AS n FROM b JOIN l{k} ON b.b = l{k}.id GROUP BY ALL), l{k + 1} AS MATERIALIZED (SELECT id, label FROM v{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1)" for k in range(10))


def _labels(i):
    return graph.label_propagation(*_web(i))


@query("g16_labelprop", f"{_lp} SELECT id, label FROM l10")
def g16(i):
    return _labels(i)


@query("g17_communities", f"{_lp}, t AS (SELECT label, count(*) AS size FROM l10 GROUP BY label ORDER BY size DESC, label LIMIT 10) SELECT label, size, id, CAST(place AS INTEGER) AS place FROM (SELECT label, size, id, row_number() OVER (PARTITION BY label ORDER BY importance DESC, id) AS place FROM l10 JOIN t USING (label) JOIN vertices USING (id)) WHERE place <= 5")
def g17(i):
    return graph.communities(_labels(i), _web(i)[0])


@query("g18_crossedges", f"{_lp} SELECT a.label AS from_label, b.label AS to_label, count(*) AS n, round(sum(weight), 6) AS weight FROM edges JOIN l10 a ON a.id = src JOIN l10 b ON b.id = dst WHERE a.label <> b.label GROUP BY ALL ORDER BY n DESC, from_label, to_label LIMIT 20")
def g18(i):
    return graph.cross_edges(_labels(i), _web(i)[1]).withColumn("weight", F.round("weight", 6))


@query("g15_paths", f"{T}, t AS (SELECT id FROM vertices ORDER BY importance DESC, id LIMIT 5), p(path, k) AS (SELECT [id], 0 FROM t UNION SELECT list_append(path, dst), k + 1 FROM p JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = path[-1] WHERE k < 2 AND NOT list_contains(path, dst)) SELECT path FROM p WHERE k > 0")
def g15(i):
    return graph.important_paths(*i.trade)


_walk = lambda hops, start: f"p(path, k) AS (SELECT [id], 0 FROM vertices WHERE {start} UNION SELECT list_append(path, dst), k + 1 FROM p JOIN edges ON src = path[-1] WHERE k < {hops} AND NOT list_contains(path, dst))"


@query("g19_samples", f"{FL}, {_walk(3, 'true')} SELECT DISTINCT array_to_string(path, ' > ') AS path FROM p WHERE k > 0 ORDER BY path LIMIT 10")
def g19(i):
    v, e = _flow(i)
    return graph.sampled_paths(v, e, v)


@query("g19_samples_mesh", f"{M}, p(path, k) AS (SELECT [id], 0 FROM vertices UNION SELECT list_append(path, dst), k + 1 FROM p JOIN (SELECT * FROM edges WHERE edge_type = 'Calls') e ON src = path[-1] WHERE k < 3 AND NOT list_contains(path, dst)) SELECT DISTINCT array_to_string(path, ' > ') AS path FROM p WHERE k > 0 ORDER BY path LIMIT 10")
def g19m(i):
    v, e = _mesh(i)
    return graph.sampled_paths(v, e, v)


@query("g20_callchain_mesh", f"{M}, p(path, k) AS (SELECT ['m:1'], 0 UNION SELECT list_append(path, dst), k + 1 FROM p JOIN (SELECT * FROM edges WHERE edge_type = 'Calls') e ON src = path[-1] WHERE k < 8 AND path[-1] <> 'm:257' AND NOT list_contains(path, dst)) SELECT DISTINCT array_to_string(path, ' -> ') AS path FROM p WHERE path[-1] = 'm:257' ORDER BY path LIMIT 20")
def g20m(i):
    return graph.call_chain(*_mesh(i), "m:1", "m:257")


_two = lambda fl, what: f"{fl}, e AS (SELECT event_type AS t FROM events GROUP BY 1), s AS (SELECT min(t) AS a, max(t) AS b FROM e), {what}"


@query("g20_callchain", _two(FL, "p(path, k) AS (SELECT [a], 0 FROM s UNION SELECT list_append(path, dst), k + 1 FROM p JOIN edges ON src = path[-1], s WHERE k < 8 AND path[-1] <> b AND NOT list_contains(path, dst)) SELECT DISTINCT array_to_string(path, ' -> ') AS path FROM p, s WHERE path[-1] = b ORDER BY path LIMIT 20"))
def g20(i):
    v, e = _flow(i)
    a, b = v.agg(F.min("name"), F.max("name")).first()
    return graph.call_chain(v, e, a, b)


@query("g20_open_chain", _two(FL, "p(path, k) AS (SELECT [a], 0 FROM s UNION SELECT list_append(path, dst), k + 1 FROM p JOIN (SELECT dst AS src, src AS dst FROM edges) x ON src = path[-1] WHERE k < 8 AND NOT list_contains(path, dst)), q AS (SELECT path FROM p WHERE NOT EXISTS (FROM p n WHERE n.k = p.k + 1 AND n.path[:-2] = p.path)) SELECT DISTINCT array_to_string(path, ' -> ') AS path FROM q ORDER BY path LIMIT 20"))
def g20b(i):
    v, e = _flow(i)
    return graph.call_chain(v, e, v.agg(F.min("name")).first()[0], upstream=True)


@query("g21_seeds", f"{T} SELECT DISTINCT id FROM vertices WHERE file_path LIKE '%nation/3' OR file_path LIKE '%gion/1' ORDER BY id LIMIT 200")
def g21(i):
    return graph.seeds_of_paths(i.trade[0], i.spark.createDataFrame([("nation/3",), ("gion/1",)], "path string"))


@query("g21_fallback", f"{T} SELECT id FROM vertices ORDER BY importance DESC, id LIMIT 20")
def g21b(i):
    return graph.seeds_of_paths(i.trade[0], i.spark.createDataFrame([("nowhere",)], "path string"))


_ef = lambda c, d="NULL": sql_case(c, EDGE_FACTORS, d)
_steps = f"""f AS MATERIALIZED (SELECT src, dst, min_by(edge_type, pos) AS t, min(pos) AS pos FROM edges GROUP BY src, dst),
st AS MATERIALIZED (SELECT b.dst AS at_, b.src AS to_, b.pos, coalesce({_ef('a.t')}, {_ef('b.t')}, CAST(0.4 AS DOUBLE)) AS factor, CASE WHEN v.id IS NULL THEN CAST(0.5 AS DOUBLE) ELSE v.importance * {sql_case('v.node_type', TYPE_FACTORS, 'CAST(1 AS DOUBLE)')} END AS weight FROM f b LEFT JOIN f a ON a.src = b.dst AND a.dst = b.src LEFT JOIN vertices v ON v.id = b.src)"""


def _propagation(depth, source):
    out = f"{T}, {_steps}, p0 AS (SELECT id, CAST(1 AS DOUBLE) AS score, 0 AS depth, [CAST(0 AS BIGINT)] AS found FROM vertices WHERE {source})"
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM p{k}" for k in range(d))
        out += f", c{d} AS (SELECT to_ AS id, score * CAST({0.8**d!r} AS DOUBLE) * factor * weight AS score, {d} AS depth, list_append(found, st.pos) AS found, at_ FROM p{d - 1} JOIN st ON at_ = id), p{d} AS MATERIALIZED (SELECT id, score, depth, found FROM c{d} WHERE score > 0.05 AND id NOT IN ({seen}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY found, at_) = 1)"
    return out + ", imp AS (SELECT *, CASE WHEN depth = 1 THEN 'Direct' WHEN score > 0.5 THEN 'Transitive' ELSE 'Conditional' END AS kind FROM (" + " UNION ALL ".join(f"SELECT id, depth, score FROM p{k}" for k in range(1, depth + 1)) + "))"


_prop = _propagation(3, "id IN ('supp:1', 'supp:2')")


def _propagated(i):
    v, e = i.trade
    return impact.propagate(v, e, v.where("id in ('supp:1', 'supp:2')"))


@query("p01_propagation", f"{_prop} SELECT id, depth, round(score, 9) AS score, kind FROM imp")
def p01(i):
    return _propagated(i).withColumn("score", F.round("score", 9))


@query("p03_edge_factors", f"{T} SELECT edge_type, {_ef('edge_type', '0.4')} AS factor, count(*) AS n FROM edges GROUP BY ALL")
def p03(i):
    return i.trade[1].groupBy("edge_type", impact.edge_factor(F.col("edge_type"), 0.4).alias("factor")).agg(F.count("*").alias("n"))


@query("p04_scope", f"""{_prop}, n AS (SELECT count(*) AS n FROM vertices), a AS (SELECT count(*) FILTER (WHERE depth = 1) AS direct, count(*) FILTER (WHERE depth > 1) AS indirect, avg(score) AS avg_score, max(depth) AS max_depth, count(*) FILTER (WHERE score > 0.7) AS high FROM imp)
SELECT direct, indirect, round(avg_score, 9) AS avg_score, max_depth, high, n AS n_nodes, round((direct + indirect) / n, 9) AS radius, round(least(CAST(1 AS DOUBLE), (direct + indirect) / n + 0.3 * avg_score + 0.02 * max_depth), 9) AS adjusted_radius FROM a, n""")
def p04(i):
    return impact.scope(_propagated(i), i.trade[0]).withColumns({c: F.round(c, 9) for c in ("avg_score", "radius", "adjusted_radius")})


@query("p05_paths", f"""{_prop}, best AS (SELECT id FROM imp ORDER BY score DESC, id LIMIT 5), src AS (SELECT id FROM vertices WHERE id IN ('supp:1', 'supp:2')),
w(source, path, weight, k) AS (SELECT id, [id], CAST(1 AS DOUBLE), 0 FROM src UNION SELECT source, list_append(path, to_), w.weight * factor * CAST(0.9 AS DOUBLE), k + 1 FROM w JOIN st ON at_ = path[-1] WHERE k < 2 AND NOT list_contains(path, to_)),
m AS (SELECT *, row_number() OVER (PARTITION BY source, path[-1] ORDER BY k, path) AS r FROM w WHERE k > 0)
SELECT source, path[-1] AS target, path, round(weight, 9) AS weight FROM m WHERE r = 1 AND path[-1] IN (FROM best) AND weight > 0.4 ORDER BY weight DESC, source, target LIMIT 5""")
def p05(i):
    v, e = i.trade
    return impact.critical_paths(v, e, v.where("id in ('supp:1', 'supp:2')"), _propagated(i), least=0.4).withColumn("weight", F.round("weight", 9))


@query("p06_radius", "SELECT p_partkey, round(least(CAST(1 AS DOUBLE), p_size / 100 + 0.3 * (p_partkey % 10) / 10 + 0.02 * (p_partkey % 4)), 9) AS radius FROM part")
def p06(i):
    k = F.col("p_partkey")
    return i.table("part").select("p_partkey", F.round(impact.adjusted_radius(F.col("p_size") / 100, (k % 10) / 10, k % 4), 9).alias("radius"))


@query("p07_conditions", f"{T} SELECT src, dst FROM edges WHERE edge_type = 'Contains' AND (src LIKE 'region:%' OR src LIKE 'nation:1%')")
def p07(i):
    e = i.trade[1].withColumn("node_type", F.when(F.col("src").startswith("region:"), "Module").when(F.col("src").startswith("nation:1"), "File")).withColumn("depth", F.lit(1))
    return e.where(impact.condition({"all": [{"edge": "Contains"}, {"any": [{"node": "Module"}, {"node": "File"}]}, {"within": 3}]})).select("src", "dst")


@query("p08_components", f"{T} SELECT id FROM vertices WHERE id = 'cust:7' OR id LIKE '%cust:7' OR name = 'cust:7' UNION ALL SELECT id FROM vertices WHERE contains(id, 'upp:') OR contains(name, 'upp:') OR contains(file_path, 'upp:')")
def p08(i):
    v = i.trade[0]
    return impact.find_components(v, "cust:7").select("id").union(impact.find_components(v, "upp:").select("id"))


@query("p09_chains", f"{FL}, p(path, k) AS (SELECT [id], 0 FROM vertices WHERE id = 'error' UNION SELECT list_append(path, src), k + 1 FROM p JOIN edges ON dst = path[-1] WHERE k < 4 AND NOT list_contains(path, src)) SELECT path FROM p WHERE k > 0")
def p09(i):
    v, e = _flow(i)
    return impact.chains(e, v.where("id = 'error'"))


@query("p09_chains_mesh", f"{M}, p(path, k) AS (SELECT [id], 0 FROM vertices WHERE id = 'm:5' UNION SELECT list_append(path, src), k + 1 FROM p JOIN edges ON dst = path[-1] WHERE k < 4 AND NOT list_contains(path, src)) SELECT path FROM p WHERE k > 0")
def p09m(i):
    v, e = _mesh(i)
    return impact.chains(e, v.where("id = 'm:5'"))


_hop = f"f AS (SELECT src, dst, min_by(edge_type, pos) AS t FROM edges GROUP BY ALL), n AS (SELECT count(*) AS n FROM vertices), vc AS (SELECT id, importance, (SELECT count(*) FROM edges WHERE src = id) + (SELECT count(*) FROM edges WHERE dst = id) AS deg FROM vertices), hop AS MATERIALIZED (SELECT b.dst AS at_, b.src AS to_, coalesce({_ef('a.t', 'CAST(0.5 AS DOUBLE)')}, CAST(0.5 AS DOUBLE)) * CAST(0.85 AS DOUBLE) * least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * importance) AS p, deg / (2 * n) AS c FROM f b JOIN vc ON vc.id = b.src LEFT JOIN f a ON a.src = b.dst AND a.dst = b.src, n)"
_sev = lambda p, c, size: f"CASE WHEN {p} > 0.8 OR {size} >= 5 OR {c} > 0.25 THEN 'High' WHEN {p} > 0.6 OR {size} >= 4 OR {c} > 0.15 THEN 'Medium' ELSE 'Low' END"


@query("p12_cascades", f"{FL}, {_hop}, w(path, p, c) AS (SELECT [id], CAST(1 AS DOUBLE), deg / (2 * n) FROM vc, n WHERE id = 'error' UNION SELECT list_append(path, to_), w.p * hop.p, greatest(w.c, hop.c) FROM w JOIN hop ON at_ = path[-1] WHERE len(path) < 5 AND NOT list_contains(path, to_) AND w.p * hop.p >= 0.3) SELECT path, round(p, 9) AS probability, {_sev('p', 'c', 'len(path)')} AS severity FROM w WHERE len(path) >= 2 ORDER BY p DESC, path LIMIT 10")
def p12(i):
    v, e = _flow(i)
    return impact.cascades(v, e, v.where("id = 'error'")).withColumn("probability", F.round("probability", 9))


@query("p12_cascades_mesh", f"{M}, {_hop}, w(path, p, c) AS (SELECT [id], CAST(1 AS DOUBLE), deg / (2 * n) FROM vc, n WHERE id = 'm:5' UNION SELECT list_append(path, to_), w.p * hop.p, greatest(w.c, hop.c) FROM w JOIN hop ON at_ = path[-1] WHERE len(path) < 5 AND NOT list_contains(path, to_) AND w.p * hop.p >= 0.05) SELECT path, round(p, 9) AS probability, {_sev('p', 'c', 'len(path)')} AS severity FROM w WHERE len(path) >= 2 ORDER BY round(p, 9) DESC, path LIMIT 10")
def p12m(i):
    v, e = _mesh(i)
    return impact.cascades(v, e, v.where("id = 'm:5'"), probability=0.05).withColumn("probability", F.round("probability", 9))


@query("p13_review", f"""{T}, {_deg}, f AS (SELECT src, dst, min_by(weight, pos) AS w FROM edges GROUP BY ALL), s AS (SELECT e.dst AS at_, e.src AS to_, coalesce(f.w, 1) * coalesce(v.importance, 0.5) * CAST(0.85 AS DOUBLE) AS factor FROM (SELECT DISTINCT src, dst FROM edges) e LEFT JOIN f ON f.src = e.dst AND f.dst = e.src LEFT JOIN vertices v ON v.id = e.src),
r(id, score, k) AS (SELECT id, CAST(1 AS DOUBLE), 0 FROM vertices WHERE id IN ('supp:1', 'supp:3') UNION SELECT to_, score * factor, k + 1 FROM r JOIN s ON s.at_ = r.id WHERE score * factor >= 0.05 AND k < 8)
SELECT id, round(score, 9) AS score, id IN (SELECT id FROM cen WHERE centrality > 0.02) AS is_critical FROM (SELECT id, max(score) AS score FROM r WHERE id NOT IN ('supp:1', 'supp:3') GROUP BY id) ORDER BY score DESC, id LIMIT 5""")
def p13(i):
    v, e = i.trade
    return impact.review(v, e, i.spark.createDataFrame([("supp:1",), ("supp:3",), ("gone",)], "id string"), 0.02).withColumn("score", F.round("score", 9))
