"""What small tables don't show: budgets that are reached, batches that are cut, frontiers and hubs beyond a limit."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from skeinlake.catalog.all import QUERIES
from skeinlake.operators import graph, impact, summary
from skeinlake.plans import tables


def test_sections_beyond_the_budget(spark, tmp_path):
    n = 400
    pq.write_table(pa.table({"page_id": pa.array(range(n), "int64"), "url": [f"http://one.example/{k}" for k in range(n)], "html": ["<p></p>"] * n}), tmp_path / "pages.parquet")
    rows = [tuple(r) for r in QUERIES["g24_sections"](spark, str(tmp_path)).collect()]
    top = [r[1] for r in rows if r[0] == "top"]
    # Equal ranks, so the ids decide; the host's is the lowest.
    assert sorted(top) == sorted(f"page:{k}" for k in range(n))[:200]
    assert ("statistics", "n_nodes", n + 1.0) in rows and ("communities", "host:one.example > page:0", n + 1.0) in rows


def _graph(spark):
    """A random graph with hubs, pairs both ways and parallel edges, and ends that are no vertices."""
    draw = random.Random(5)
    edges = [(f"n{min(draw.randrange(60), draw.randrange(60))}", f"n{draw.randrange(60)}", draw.choice(["Calls", "Imports", "Contains"]), draw.choice([0.5, 0.8, 1.0]), k) for k in range(260)]
    v = [(f"n{k}", draw.choice(["Function", "Class", "File"]), draw.choice([0.5, 0.8, 1.0])) for k in range(57)]
    return spark.createDataFrame(v, "id string, node_type string, importance double"), spark.createDataFrame(edges, "src string, dst string, edge_type string, weight double, pos long")


def test_steps_of_a_level_alone_give_what_all_steps_give(spark, monkeypatch):
    v, e = _graph(spark)
    seeds = v.where("id in ('n3', 'n41')")

    def rows():
        found = impact.propagate(v, e, seeds)
        out = [found, impact.critical_paths(v, e, seeds, found, least=0.1), graph.weighted_impact(v, e, seeds), graph.weighted_impact(v, e, seeds, reverse_weight=True)]
        return [sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr) for df in out]

    narrow = rows()
    monkeypatch.setattr(tables, "NARROW", 0)
    assert narrow == rows() and len(narrow[0]) > 10
    monkeypatch.setattr(tables, "NARROW", 100)
    monkeypatch.setattr(tables, "ROUNDS", 1)
    assert narrow == rows()


def test_steps_of_a_level_read_its_own_edges(spark):
    v, e = _graph(spark)
    at = v.where("id in ('n3', 'n41')").select("id")
    pairs, ahead, known = graph.pairs_back(v, e, "edge_type", at)
    assert pairs.count() < 60 and pairs.where("dst not in ('n3', 'n41')").isEmpty() and ahead.where("src not in ('n3', 'n41')").isEmpty()
    assert sorted(map(tuple, impact.steps_back(v, e, at).collect())) == sorted(map(tuple, impact.steps_back(v, e).where("at in ('n3', 'n41')").collect()))


def test_hubs_have_several_rows_of_links(spark, monkeypatch):
    v, e = _graph(spark)
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    ranks, labels = rows(graph.pagerank(v, e, rounds=3)), rows(graph.label_propagation(v, e, rounds=3))
    assert len(ranks) == len(labels) == 57
    monkeypatch.setattr(graph, "HEAVY", 3)
    monkeypatch.setattr(graph, "PAIRS", 40)
    nodes, _ = graph.numbers(v)
    links, partitions = graph.linked(nodes, e.select("src", "dst").distinct())
    assert partitions > 4 and links.count() > links.select("n").distinct().count()
    assert ranks == rows(graph.pagerank(v, e, rounds=3)) and labels == rows(graph.label_propagation(v, e, rounds=3))


def test_numbers_follow_the_order_of_ids(spark):
    ids = [f"x{k}" for k in range(50)] + ["", "é", "Z", "~"]
    nodes, n = graph.numbers(spark.createDataFrame([(x,) for x in ids * 2], "id string").repartition(7))
    assert n == len(ids) and [r["id"] for r in nodes.orderBy("n").collect()] == sorted(ids, key=lambda x: x.encode())


def test_summary_reads_what_its_graph_is_made_of_once(spark):
    v, e = _graph(spark)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    v = v.withColumns({"name": v["id"], "file_path": v["id"]})
    rows, schema = v.count(), v.schema
    summary.graph_summary(v.mapInArrow(counted, schema), e, v.select("id").limit(0).withColumnRenamed("id", "path"), rounds=2, tokens=0)
    assert read.value == rows
