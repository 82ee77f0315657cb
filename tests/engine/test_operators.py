"""Small hand-computed cases of the operators."""

import datetime as dt
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinlake.operators import build, diff, extract, graph, impact, ops, render, rules, summary, trends
from skeinlake.plans.query import Criteria, Filter, Page
from skeinlake.sources import files, json

V = "id string, node_type string, name string, file_path string, importance double"
E = "src string, dst string, edge_type string, weight double, pos long"


def vertices(spark, names, importance=0.5):
    return spark.createDataFrame([(n, "Function", n, "f.rs", importance) for n in names], V)


def edges(spark, pairs, kind="Calls", weight=1.0):
    return spark.createDataFrame([(a, b, kind, weight, k) for k, (a, b) in enumerate(pairs)], E)


def ids(df, *columns):
    return {tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


# Graphs


def test_reverse_scope_of_a_chain(spark):
    got = graph.reach(edges(spark, [("B", "A"), ("C", "B"), ("D", "C")]), vertices(spark, "A"), 3)
    assert ids(got, "id", "depth") == {("A", 0), ("B", 1), ("C", 2), ("D", 3)}
    assert ids(graph.reach(edges(spark, [("B", "A"), ("C", "B"), ("D", "C")]), vertices(spark, "A"), 1), "id") == {"A", "B"}


def test_cycles(spark):
    ring = [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("E", "A")]
    assert ids(graph.on_cycles(edges(spark, ring)), "id") == {"A", "B", "C"}
    assert graph.on_cycles(edges(spark, ring[:2])).count() == 0
    assert ids(graph.on_cycles(edges(spark, [("A", "A"), ("A", "B")])), "id") == {"A"}
    assert graph.would_cycle(edges(spark, ring[:2]), "C", "A") and not graph.would_cycle(edges(spark, ring[:2]), "A", "C")


def test_levels_stop_at_a_cycle(spark):
    v = vertices(spark, "ABCDE")
    assert ids(graph.levels(v, edges(spark, [("A", "B"), ("B", "C"), ("A", "C"), ("D", "C")])), "id", "level") == {("A", 0), ("D", 0), ("E", 0), ("B", 1), ("C", 2)}
    assert graph.levels(v, edges(spark, [("A", "B"), ("B", "A")])).count() == 3


def _pagerank(nodes, pairs, rounds, d=0.85):
    out = {n: [b for a, b in pairs if a == n] for n in nodes}
    r = {n: 1 / len(nodes) for n in nodes}
    for _ in range(rounds):
        lost = sum(r[n] for n in nodes if not out[n])
        r = {n: (1 - d) / len(nodes) + d * sum(r[a] / len(out[a]) for a, b in pairs if b == n) + d * lost / len(nodes) for n in nodes}
    return r


def test_pagerank_counts_parallel_edges(spark):
    pairs = [("A", "B"), ("A", "B"), ("A", "C"), ("B", "C"), ("D", "A")]
    got = {r["id"]: r["pagerank"] for r in graph.pagerank(vertices(spark, "ABCD"), edges(spark, pairs), rounds=6, tolerance=0).collect()}
    want = _pagerank("ABCD", pairs, 6)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1)
    assert graph.pagerank(vertices(spark, "AB").limit(0), edges(spark, pairs)).count() == 0
    half = graph.pagerank(vertices(spark, "ABCD"), edges(spark, pairs, weight=0.5), rounds=3, tolerance=0)
    assert half.agg(F.sum("pagerank")).first()[0] < 1


def test_label_propagation_finds_cliques(spark):
    clique = lambda names: list(itertools.combinations(names, 2))
    got = graph.label_propagation(vertices(spark, "ABCDWXYZI"), edges(spark, clique("ABCD") + clique("WXYZ") + [("D", "W")]))
    labels = dict(ids(got, "id", "label"))
    assert {labels[c] for c in "ABCD"} == {"A"} and len({labels[c] for c in "WXYZ"}) == 1 and labels["I"] == "I" and labels["W"] != "A"


def test_weighted_impact(spark):
    v, e = vertices(spark, "ABC", 0.8), edges(spark, [("B", "A"), ("C", "B")], weight=0.5)
    assert dict(ids(graph.weighted_impact(v, e, v.where("id = 'A'")), "id", "score")) == pytest.approx({"A": 1.0, "B": 0.68, "C": 0.4624})
    assert dict(ids(graph.weighted_impact(v, e, v.where("id = 'A'"), reverse_weight=True), "id", "score")) == pytest.approx({"A": 1.0, "B": 0.34, "C": 0.1156})


def test_call_chain(spark):
    v, e = vertices(spark, "ABCD"), edges(spark, [("A", "B"), ("B", "C"), ("A", "C"), ("C", "D"), ("D", "A")])
    assert ids(graph.call_chain(v, e, "A", "D"), "path") == {"A -> B -> C -> D", "A -> C -> D"}
    assert ids(graph.call_chain(v, e, "A", "A"), "path") == {"A"}
    assert ids(graph.call_chain(v, e, "C", upstream=True, depth=1), "path") == {"C -> A", "C -> B"}


def test_statistics_count_internal_edges(spark):
    r = graph.statistics(vertices(spark, "AB"), edges(spark, [("A", "B"), ("A", "X")]), 0.6).first()
    assert (r["n_nodes"], r["n_edges"], r["avg_degree"], r["n_critical"]) == (2, 1, 1.0, 0)


# Impact


def test_propagation_decays_twice(spark):
    v, e = vertices(spark, ["func1", "func2", "func3", "func4", "func5"], 0.8), edges(spark, [("func2", "func1"), ("func3", "func2"), ("func4", "func3"), ("func5", "func1")])
    got = {r["id"]: r for r in impact.propagate(v, e, v.where("id = 'func1'"), 3).collect()}
    one = 0.8 * 0.9 * 0.8
    assert got["func2"]["score"] == pytest.approx(one) and got["func2"]["kind"] == "Direct" == got["func5"]["kind"]
    assert got["func3"]["score"] == pytest.approx(one * 0.64 * 0.9 * 0.8) and got["func3"]["kind"] == "Conditional"
    s = impact.scope(impact.propagate(v, e, v.where("id = 'func1'"), 3), v).first()
    assert s["direct"] == 2 and s["direct"] + s["indirect"] == len(got)


def test_cascades(spark):
    v = vertices(spark, "ABCDE", 0.7)
    e = edges(spark, [("B", "A"), ("C", "B"), ("D", "C"), ("E", "A")])
    got = impact.cascades(v, e, v.where("id = 'A'")).collect()
    assert {tuple(r["path"]) for r in got} == {("A", "B"), ("A", "E")} and got[0]["probability"] == pytest.approx(0.5 * 0.85 * 0.85)
    longer = impact.cascades(v, e, v.where("id = 'A'"), reverse_factor=True)
    assert ("A", "B", "C") in {tuple(r["path"]) for r in longer.collect()}


def test_components_fall_back_to_parts_of_names(spark):
    v = spark.createDataFrame([("func:a.rs::run", "Function", "run", "a.rs", 0.5), ("file:src/b.rs", "File", "src/b.rs", "src/b.rs", 0.5)], V)
    assert ids(impact.find_components(v, "run"), "id") == {"func:a.rs::run"} and ids(impact.find_components(v, "b.rs"), "id") == {"file:src/b.rs"} and ids(impact.find_components(v, "a.r"), "id") == {"func:a.rs::run"}


# Build


def test_calls_resolve_by_range_and_unique_name(spark):
    f = spark.createDataFrame([("a", "outer", 0, 1, 20, 0, "public", False), ("a", "inner", 1, 5, 9, 0, None, True), ("b", "only", 0, 1, 5, 2, None, False), ("b", "twice", 1, 7, 9, 0, None, False), ("c", "twice", 0, 1, 3, 0, None, False)], "file_path string, name string, ord long, line_start int, line_end int, n_params int, visibility string, is_async boolean")
    c = spark.createDataFrame([(1, "a", "only", 6), (2, "a", "twice", 7), (3, "a", "inner", 15), (4, "a", "only", 99)], "call_id long, file_path string, callee string, line int")
    assert ids(build.enclosing(c, f), "call_id", "caller") == {(1, "outer"), (2, "outer"), (3, "outer")}
    assert ids(build.resolved_calls(c, f), "src", "dst") == {("func:a::outer", "func:b::only"), ("func:a::outer", "func:a::inner")}
    k = spark.createDataFrame([("a", "K", 0, 21, 4, "Base", True)], "file_path string, name string, ord long, n_methods int, n_implements int, extends string, is_abstract boolean")
    nodes, calls = build.global_graph(f, k, c)
    assert nodes.count() == 3 + 5 + 1 and calls.count() == 2 and build.global_graph(f, k, c, faithful=True)[1].count() == 3
    imp = {r["id"]: r["importance"] for r in nodes.collect()}
    assert imp["func:a::outer"] == pytest.approx(0.7) and imp["func:b::only"] == pytest.approx(0.54) and imp["class:a::K"] == 1.0
    with pytest.raises(ValueError):
        build.guard_size(f, most=4)


# Diffs


def test_function_comparison(spark):
    schema = "name string, n_params long, return_type string, visibility string, parameters array<string>"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    empty = make(("x", 0, None, None, [])).limit(0)
    kinds = lambda a, b: [(r["change_type"], r["impact"]) for r in diff.compare_functions(a, b).collect()]
    one = ("f", 1, "i32", None, ["i32"])
    assert kinds(empty, empty) == [] and kinds(empty, make(one)) == [("FunctionAdded", "Minimal")] and kinds(make(one), empty) == [("FunctionRemoved", "Project")]
    assert kinds(make(one), make(("f", 2, "i32", None, ["i32", "bool"]))) == [("ParameterCountChanged", "Module")]
    assert kinds(make(one), make(("f", 1, "String", None, ["i32"]))) == [("ReturnTypeChanged", "Module")]
    assert kinds(make(one), make(("f", 1, "i32", "pub", ["u8"]))) == [("VisibilityChanged", "Local"), ("FunctionSignatureChanged", "Module")]
    a, b = spark.createDataFrame([("HashMap",)], "name string"), spark.createDataFrame([("HashSet",)], "name string")
    assert [r["change_type"] for r in diff.compare_imports(a, b).collect()] == ["ModuleStructureChanged"] * 2


def test_diff_events_and_languages(spark):
    text = "junk\ndiff --git a/x.rs b/x.rs\n--- a/x.rs\n+++ b/x.rs\n-fn gone(a: i32) {\n+pub fn fresh() {\n+struct S {\n keep\n\n after blank\ndiff --git a/y.json b/y.json\n+trait T {\n+class Z:\n"
    lines = spark.createDataFrame([(1, k, s) for k, s in enumerate(text.split("\n"))], "diff_id long, pos int, line string")
    events = diff.change_events(lines)
    assert ids(events, "kind", "name", "change", "path") == {("function", "gone", "removed", "x.rs"), ("function", "fresh", "added", "x.rs"), ("struct", "S", "added", "x.rs"), ("interface", "T", "added", "y.json"), ("struct", "Z", "added", "y.json")}
    assert diff.diff_risk(events).first()["risk"] == "High"
    assert ids(diff.diff_languages(lines), "language") == {"rust"} and ids(diff.diff_languages(lines, faithful=True), "language") == {"rust", "javascript"}
    assert diff.code_by_language(lines).first()["code"] == "pub fn fresh() {\nstruct S {\nkeep"
    assert diff.line_counts(lines).first()["changed"] == 5 and diff.first_language(lines).first()["language"] == "rust"


# Rules and trends


def test_risk_score_by_hand(spark):
    c = spark.createDataFrame([(1, "r", "FunctionRemoved", "a"), (2, "r", "FunctionAdded", "b")], "change_id long, review string, change_type string, component string")
    assert rules.risk_score(c, "review").first()["risk_score"] == (90 * 10 + 15 * 2) // 12 and rules.overall_risk(c, "review").first()["overall_risk"] == "Critical"
    assert [r["place"] for r in rules.mitigations(c, "review").orderBy("place").collect()] == [1, 2, 3]


def test_runs_of_equal_lines(spark):
    make = lambda ls: spark.createDataFrame([(1, k, s) for k, s in enumerate(ls)], "doc long, pos int, line string")
    assert rules.repeated_lines(make(["a", "a", "", "a", "a", "b"]), "doc").first()[1:] == ("a", 0, 4)
    assert rules.repeated_lines(make(["a", "a", "a", "b", "a"]), "doc").count() == 0


def test_quality_score_bounds(spark):
    n = F.lit(None).cast("double")
    row = spark.range(1).select(rules.quality_score(n, n, n, n, n, n).alias("a"), rules.quality_score(F.lit(15.0), F.lit(4.0), F.lit(60.0), F.lit(0.5), F.lit(3), F.lit(1)).alias("b"), rules.quality_score(F.lit(500.0), n, n, n, n, n).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (100.0, 100 - 10 - 2 - 10 - 5 - 6 - 10, 0.0)


SNAP = "branch string, ts timestamp_ntz, commit_hash string, debt double, complexity double, stability double, coupling double, lines_of_code long, cycles long, public_apis long, tags array<string>"


def snapshots(spark, values, branch="main"):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(branch, start + dt.timedelta(days=10 * k), f"c{k}", float(d), float(c), 90.0, 10.0, 1000, 0, 10 - k, ["t"]) for k, (d, c) in enumerate(values)], SNAP)


def test_rising_debt_is_degrading(spark):
    s = snapshots(spark, [(30, 5), (35, 5.5), (40, 6), (45, 6.5)])
    got = {r["metric"]: r for r in trends.change_rates(trends.first_last(s, "branch")).collect()}
    assert got["debt"]["direction"] == "Degrading" and got["debt"]["rate"] == pytest.approx(50) and got["debt"]["significance"] == "High" and got["stability"]["direction"] == "Stable"
    assert trends.overall_trend(trends.change_rates(trends.first_last(s, "branch")), "branch").first()["overall"] == "Degrading"
    assert trends.predictions(s, "branch").count() == 0 and trends.first_last(s.limit(1), "branch").count() == 0
    rates = trends.change_rates(trends.first_last(s, "branch"))
    assert ids(trends.trend_advice(rates, "branch"), "metric") == {"debt", "complexity"} and trends.trend_advice(rates, "branch", faithful=True).count() == 0


def test_outlier_is_an_anomaly(spark):
    got = trends.anomalies(snapshots(spark, [(30, 5), (32, 5.2), (80, 5.3), (35, 5.5)]), "branch").collect()
    assert ("debt", 80.0) in {(r["metric"], r["value"]) for r in got}


def test_comparison_retention_and_api_delta(spark):
    s = snapshots(spark, [(50, 30), (45, 35)])
    r = trends.compare(s, "branch", 1, 0).first()
    assert r["debt_change"] < 0 < r["complexity_change"]
    assert trends.retain(s, F.expr("TIMESTAMP_NTZ '2024-01-11 00:00:00'"), 5).count() == 1
    assert [(r["new_apis"], r["removed_apis"]) for r in trends.api_delta(s, "branch").orderBy("ts").collect()] == [(10, 0), (0, 1)]


def test_adjacent_duplicates_only(spark):
    a = snapshots(spark, [(1, 1), (2, 2), (3, 3)])
    assert trends.merged(a, a.withColumn("branch", F.lit("x"))).count() == 3
    assert trends.merged(a, a.limit(0)).count() == 3


# Operations, query


def test_registry(spark):
    s = spark.createDataFrame([("a", "1.2.3", "Up"), ("b", "2.0.0", "Down"), ("c", "0.9.0", "Up")], "service string, version string, status string")
    r = spark.createDataFrame([("x", "a", ">=1.2.0", False), ("x", "b", "1.0.0", False), ("x", "c", "1.0.0", False), ("x", "d", "1.0.0", False), ("x", "e", "1.0.0", True)], "service string, needs string, wanted string, optional boolean")
    assert ids(ops.unmet_dependencies(s, r), "needs", "problem") == {("b", "not up"), ("c", "version"), ("d", "missing")}
    v = spark.createDataFrame([("1.10.0", "1.9.9"), ("2.0.0", "1.0.0"), ("bad", "1.0.0")], "a string, b string").select(ops.compatible(ops.version(F.col("a")), ops.version(F.col("b"))).alias("x"))
    assert [r[0] for r in v.collect()] == [True, False, None]


def test_page_bounds():
    assert Page().offset == 0 and Page(3, 25).offset == 50 and Page(1, 20).total_pages(41) == 3 and Page(3, 20).has_next(41) is False
    for bad in ((0, 20), (1, 0), (1, 1001)):
        with pytest.raises(ValueError):
            Page(*bad)


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(k, k % 7 if k % 5 else None, f"n{k}") for k in range(40)], "k int, v int, s string").cache()


_filters = st.lists(st.one_of(st.tuples(st.sampled_from(["eq", "ne", "gt", "lt", "ge", "le"]), st.integers(-1, 8)), st.tuples(st.sampled_from(["in", "not_in"]), st.lists(st.integers(0, 7), min_size=1, max_size=3)), st.tuples(st.sampled_from(["is_null", "is_not_null"]), st.none())), max_size=3)
_py = {"eq": lambda v, x: v is not None and v == x, "ne": lambda v, x: v is not None and v != x, "gt": lambda v, x: v is not None and v > x, "lt": lambda v, x: v is not None and v < x, "ge": lambda v, x: v is not None and v >= x, "le": lambda v, x: v is not None and v <= x, "in": lambda v, x: v is not None and v in x, "not_in": lambda v, x: v is not None and v not in x, "is_null": lambda v, x: v is None, "is_not_null": lambda v, x: v is not None}


@settings(max_examples=15, deadline=None)
@given(_filters)
def test_generated_filters(numbers, generated):
    got = Criteria([Filter("v", o, x) for o, x in generated], [("k", False)]).apply(numbers).collect()
    want = [k for k in reversed(range(40)) if all(_py[o](k % 7 if k % 5 else None, x) for o, x in generated)]
    assert [r["k"] for r in got] == want


# Sources, extraction, rendering


def test_read_a_source_tree(spark, tmp_path):
    for path, text in {"src/a.rs": "fn main() {\n}\n", "src/test_b.py": "def f():\n    pass\n", "target/c.rs": "x", "notes.txt": "n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    tree = files.read_tree(spark, str(tmp_path))
    name = lambda df: {r["path"].rsplit("/", 1)[1] for r in df.collect()}
    assert tree.count() == 4 and name(files.code_files(tree)) == {"a.rs", "test_b.py"} and name(files.code_files(tree, skip_tests=True)) == {"a.rs"}
    f = extract.functions(extract.code_lines(files.code_files(tree)))
    assert ids(f, "name", "line_start", "line_end") == {("main", 1, 2), ("f", 1, 3)}


def test_snapshot_files_round_trip(spark, tmp_path):
    s = snapshots(spark, [(1, 2), (3, 4)], "feat/x").select("branch", "ts", "commit_hash", "debt", "complexity", "lines_of_code", "tags")
    t = snapshots(spark, [(9, 9)], "main").select(s.columns)
    at = str(tmp_path / "store")
    json.append_snapshots(s, at)
    json.append_snapshots(t, at)
    assert json.read_appended(spark, at).count() == 3 and ids(json.read_appended(spark, at), "branch") == {"feat/x", "main"}
    json.overwrite_branches(s.limit(1), at)
    assert json.read_appended(spark, at).groupBy("branch").count().collect().__len__() == 2 and json.read_appended(spark, at).count() == 2
    (tmp_path / "snapshots_dev.jsonl").write_text('{"ts":"2024-01-01T00:00:00","debt":1.5}\nnot json\n{"ts":"2024-01-02T00:00:00","debt":2.5}\n')
    assert ids(json.read_snapshots(spark, str(tmp_path)), "branch", "debt") == {("dev", 1.5), ("dev", 2.5)}
    json.export_csv(snapshots(spark, [(1, 2)]), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["debt"] == "1.00"


def test_budget_cuts_in_order():
    sizes = lambda p: {"seeds": p.seeds, "top": p.top, "kept": 3000 if p.radius > 1 else 100, "communities": p.communities, "community_edges": 2 * p.communities, "path_nodes": 4 * p.paths}
    full = summary.Plan(2, 300, 10, 5, 20)
    assert summary.fit_budget(full, 0, sizes) == full and summary.fit_budget(full, 10**6, sizes) == full
    cut = summary.fit_budget(full, 10, sizes)
    assert (cut.radius, cut.top, cut.communities, cut.paths, cut.seeds, cut.truncated) == (1, 150, 5, 3, 10, True)


def test_tiny_summary_is_truncated(spark):
    v, e = vertices(spark, ["f1", "f2"]), edges(spark, [("f1", "f2")])
    parts, plan = summary.graph_summary(v, e, radius=2, top=300, tokens=10, rounds=2)
    assert plan.truncated or summary.estimate(2, 2, 2, 10, 20, 20) <= 2000
    assert ids(parts["paths"], "path") == {"f1 > f2"}


def test_dot_and_ascii(spark):
    v, e = vertices(spark, ["func:A", "func:B"]), edges(spark, [("func:A", "func:B")])
    dot = render.document(render.dot_lines(v, e, v.where("id = 'func:A'")))
    assert dot.startswith("digraph G {") and "->" in dot and "Calls" in dot and 'color="red"' in dot and dot.endswith("}")
    assert render.document(render.ascii_lines(v, e)) == "N0 [fn func:A()]\nN1 [fn func:B()]\nN0 -> N1 (Calls)"
    assert "N0 --> N1" in render.document(render.mermaid_lines(v, e))


def test_conditions(spark):
    df = spark.createDataFrame([("Calls", "File", 1), ("Imports", "File", 2)], "edge_type string, node_type string, depth int")
    assert df.where(impact.condition({})).count() == 2 and df.where(impact.condition({"all": [{"node": "File"}, {"within": 1}]})).count() == 1 and df.where(impact.condition({"any": []})).count() == 0


def test_settings(tmp_path):
    from skeinlake.sources import config

    (tmp_path / "a.toml").write_text("[graph]\nradius = 3\nunknown = 1\n")
    (tmp_path / "b.json").write_text('{"damping": 1.5}')
    assert config.load(str(tmp_path / "a.toml"), "graph") == config.Settings(radius=3) and config.load(str(tmp_path / "a.toml")) == config.Settings()
    with pytest.raises(ValueError, match="damping"):
        config.load(str(tmp_path / "b.json"))

def test_hubs_are_spread(spark):
    """A held table with heavy keys joins as one without."""
    from skeinlake.plans.tables import held_by

    rows = [(f"n{k}", "hub") for k in range(50)] + [(f"m{k}", f"x{k % 7}") for k in range(30)] + [("n1", "hub")]
    e = spark.createDataFrame(rows, "src string, dst string")
    other = spark.createDataFrame([("hub", 1), ("x1", 2), ("none", 3), ("hub", 4)], "id string, v int")
    plain, spread = held_by(e, "dst"), held_by(e, "dst", most=8)
    assert plain.heavy is None and {tuple(r) for r in spread.heavy.collect()} == {("hub", 7)}
    assert sorted(map(tuple, plain.meets(other, "id").select("src", "dst", "v").collect())) == sorted(map(tuple, spread.meets(other, "id").select("src", "dst", "v").collect()))
    plain.unpersist()
    spread.unpersist()


def test_cycles_of_several_components(spark):
    pairs = ["AB", "BC", "CA", "CD", "DE", "EF", "FE", "FG", "HH", "XY", "IJ", "JK", "KI", "KE"]
    e = spark.createDataFrame([(a, b) for a, b in pairs], "src string, dst string")
    assert sorted(r[0] for r in graph.on_cycles(e).collect()) == list("ABCEFHIJK")
    assert graph.on_cycles(e.where("false")).count() == 0


def test_rising_scores_are_refused(spark):
    v = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "id string, importance double")
    e = spark.createDataFrame([("a", "b", "Calls", 2.0, 0), ("b", "a", "Calls", 2.0, 1)], "src string, dst string, edge_type string, weight double, pos long")
    with pytest.raises(ValueError):
        graph.weighted_impact(v, e, v.where("id = 'a'"))


def test_image_keeps_the_text(tmp_path):
    import shutil

    at = str(tmp_path / "g.svg")
    if shutil.which("dot"):
        assert "<svg" in open(render.image("digraph G { a -> b }", at)).read()
    else:
        with pytest.raises(RuntimeError):
            render.image("digraph G { a -> b }", at)
    assert (tmp_path / "g.dot").read_text() == "digraph G { a -> b }"
    with pytest.raises(ValueError):
        render.image("digraph G {}", at, "gif")
