"""Analytics over vertices (id, ...) and edges (src, dst, edge_type, weight, pos). Edges are a multigraph: parallel ones count.

Traversals go level by level: a join of the frontier with the edges, an anti-join with what was seen. Each level is settled in
the shared folder, so plans stay short and executors may be lost.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import HEAVY, Sought, held_by, measured, settled

#: Pairs in a partition of links at most, unless a node has more.
PAIRS = 10_000_000


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(id, relation): what a node depends on and what depends on it, each edge."""
    return edges.where(F.col("src") == node).select(F.col("dst").alias("id"), F.lit("dependency").alias("relation")).unionByName(edges.where(F.col("dst") == node).select(F.col("src").alias("id"), F.lit("dependent").alias("relation")))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, targets) with parallel edges kept, sorted."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("targets"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth): nodes from which a seed is reached within so many edges (against their direction), with the least number."""
    pairs = held_by(edges.select("src", "dst").distinct(), "dst")
    level = settled(seeds.select("id").distinct(), "reach-0")
    seen = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        new = pairs.meets(level, "id").select(F.col("src").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        level, found = measured(new, f"reach-{d}")
        if not found["n"]:
            break
        seen = seen.unionByName(level.withColumn("depth", F.lit(d)))
    pairs.unpersist()
    return seen


def neighbourhood(edges: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """(id, depth) within a radius of the seeds, both ways."""
    return reach(both_ways(edges), seeds, radius)


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, centrality): counts of edge rows, and their sum by twice the number of vertices. Edges are read once: each counts at both its ends."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out")))))
    counts = ends.groupBy("id").agg(F.sum("out").alias("fan_out"), F.count("*").alias("both"))
    n = vertices.agg(F.count("*").alias("n"))
    fan_out, both = F.coalesce("fan_out", F.lit(0)), F.coalesce("both", F.lit(0))
    return vertices.select("id").join(counts, "id", "left").crossJoin(F.broadcast(n)).select("id", (both - fan_out).alias("fan_in"), fan_out.alias("fan_out"), (both / (2 * F.col("n"))).alias("centrality"))


def critical(vertices: DataFrame, edges: DataFrame, threshold: float, inclusive: bool = False) -> DataFrame:
    """Nodes whose centrality is above the threshold, or reaches it."""
    d = degrees(vertices, edges)
    return d.where(F.col("centrality") >= threshold if inclusive else F.col("centrality") > threshold)


def internal_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are both vertices."""
    ids = vertices.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def statistics(vertices: DataFrame, edges: DataFrame, threshold: float = 0.1) -> DataFrame:
    """One row: nodes, internal edges, mean degree 2E/N, nodes above the threshold."""
    n = vertices.agg(F.count("*").alias("n_nodes"))
    e = internal_edges(vertices, edges).agg(F.count("*").alias("n_edges"))
    c = critical(vertices, edges, threshold).agg(F.count("*").alias("n_critical"))
    return n.crossJoin(e).crossJoin(c).select("n_nodes", "n_edges", F.coalesce(F.try_divide(2 * F.col("n_edges"), F.col("n_nodes")), F.lit(0.0)).alias("avg_degree"), "n_critical")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left after nodes without an edge in, or out, are taken away again and again: all cycles lie in it."""
    rest, now = measured(edges.select("src", "dst").distinct(), "core-0")
    n, k = -1, 0
    while now["n"] not in (0, n):
        n, k = now["n"], k + 1
        kept = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = kept.join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        rest, now = measured(kept, f"core-{k}")
    return rest


def spread(edges: DataFrame, start: DataFrame, name: str) -> DataFrame:
    """(id, least): the least value of `start` (id, least) among the nodes that a node is reached from. Only what fell in a round is passed on in the next."""
    steps = held_by(edges.select("src", "dst"), "src")
    new = settled(start, f"{name}-0")
    parts, k = [new], 0
    while True:
        known = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).groupBy("id").agg(F.min("least").alias("least"))
        sent = steps.meets(new, "id").groupBy(F.col("dst").alias("id")).agg(F.min("least").alias("least"))
        fell = sent.join(known.withColumnRenamed("least", "_old"), "id", "left").where("_old is null or least < _old").select("id", "least")
        k += 1
        new, found = measured(fell, f"{name}-{k}")
        if not found["n"]:
            break
        # Every few rounds what fell is merged into one table, so that a round reads few.
        parts = [parts[0], new if len(parts) == 1 else parts[1].unionByName(new)]
        if k % 8 == 0:
            parts = [settled(parts[0].unionByName(parts[1]).groupBy("id").agg(F.min("least").alias("least")), f"{name}-all-{k}")]
    steps.unpersist()
    return known


def on_cycles(edges: DataFrame) -> DataFrame:
    """(id) of nodes that reach themselves: those of strongly connected components of two nodes or more, or with an edge to themselves.

    Components are found by colours: each node takes the least id that it is reached from, and those of a colour that reach
    its namesake are one component. These are taken away and the rest is coloured again. Tables stay as large as the edges.
    """
    out = edges.where("src = dst").select(F.col("src").alias("id")).distinct()
    rest, k = cyclic_core(edges.where("src <> dst")), 0
    while not rest.isEmpty():
        ids = rest.select(F.col("src").alias("id")).distinct()
        colour = settled(spread(rest, ids.withColumn("least", F.col("id")), f"colour-{k}"), f"colours-{k}")
        inner = rest.join(colour.toDF("src", "_a"), "src").join(colour.toDF("dst", "_b"), "dst").where("_a = _b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where("id = least")
        # Backwards from the namesakes, inside their colours.
        member = settled(spread(inner, roots, f"member-{k}"), f"members-{k}")
        large = member.groupBy("least").agg(F.count("*").alias("n")).where("n > 1").select("least")
        out = out.union(member.join(large, "least", "left_semi").select("id"))
        gone = member.select(F.col("id").alias("_gone"))
        left = rest.join(gone, F.col("src") == F.col("_gone"), "left_anti").join(gone, F.col("dst") == F.col("_gone"), "left_anti")
        rest, k = cyclic_core(left), k + 1
    return out.distinct()


def would_cycle(edges: DataFrame, src: str, dst: str) -> bool:
    """Whether one more edge closes a cycle: then a registration is to be refused."""
    new = edges.select("src", "dst").union(edges.sparkSession.createDataFrame([(src, dst)], "src string, dst string"))
    return not on_cycles(new).where(F.col("id") == src).isEmpty()


def levels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): the longest path that ends at a node. Nodes that a cycle holds back have no level: compare counts to see whether there is one.

    Each round writes the nodes whose last sources got a level, with no edge left to wait for, and those that still wait; nodes
    that no levelled one points to aren't touched.
    """
    pairs = settled(internal_edges(vertices, edges).select("src", "dst").distinct(), "levels-edges")
    waits = settled(vertices.select("id").distinct().join(pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("all")), "id", "left"), "levels-waits")
    steps = held_by(pairs, "src")
    state = waits.where("all is null").select("id", F.lit(0).cast("long").alias("left"))
    done, k = [], 0
    while True:
        state, found = measured(state, f"levels-{k}", free=F.count_if(F.col("left") == 0))
        done.append(state.where("left = 0").select("id", F.lit(k).alias("level")))
        if not found["free"]:
            break
        free, waiting = state.where("left = 0").select("id"), state.where("left > 0").select("id", F.col("left").alias("_left"))
        got = steps.meets(free, "id").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_got"))
        state = got.join(waiting, "id", "full_outer").join(waits, "id").select("id", (F.coalesce("_left", "all") - F.coalesce("_got", F.lit(0))).alias("left"))
        k += 1
    steps.unpersist()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pairs_back(vertices: DataFrame, edges: DataFrame, kept: str, at: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What steps against the edges from some nodes (id) are made of, or from all: the pairs (src, dst, kept, pos) of edges to them, each with the first edge's value; the pairs the other way; the vertices stepped to.

    Edges are filtered by the nodes before they're grouped, so a few nodes cost a scan, without an exchange of all edges.
    """
    first = lambda e: e.groupBy("src", "dst").agg(F.min_by(kept, "pos").alias(kept), F.min("pos").alias("pos"))
    if at is None:
        pairs = settled(first(edges), "back-pairs")
        return pairs, pairs, vertices
    at = F.broadcast(at.select(F.col("id").alias("_at")))
    pairs = settled(first(edges.join(at, F.col("dst") == F.col("_at"), "left_semi")), "back-pairs")
    to = pairs.select(F.col("src").alias("_to"))
    ahead = first(edges.join(at, F.col("src") == F.col("_at"), "left_semi").join(to, F.col("dst") == F.col("_to"), "left_semi"))
    return pairs, ahead, vertices.join(to, F.col("id") == F.col("_to"), "left_semi")


def weighted_impact(vertices: DataFrame, edges: DataFrame, seeds: DataFrame, start: float = 1.0, decay: float = 0.85, floor: float = 0.05, reverse_weight: bool = False) -> DataFrame:
    """(id, score): the best product of weight, importance and decay on a way against the edges, as long as it is at least the floor.

    The weight is that of the first edge in the forward direction, 1 without one; reverse_weight takes that of the edge walked.
    A round writes the scores that rose, and ends when none did. A factor above 1 on a cycle would never end: once a score rises by one, a graph with cycles raises.
    """

    def factors(at: DataFrame | None) -> DataFrame:
        pairs, ahead, known = pairs_back(vertices, edges, "weight", at)
        first = (pairs if reverse_weight else ahead).select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("weight").alias("w"))
        on = (F.col("at") == F.col("_d")) & (F.col("to") == F.col("_s")) if reverse_weight else (F.col("at") == F.col("_s")) & (F.col("to") == F.col("_d"))
        imp = known.select(F.col("id").alias("to"), "importance")
        return pairs.select(F.col("dst").alias("at"), F.col("src").alias("to")).join(first, on, "left").join(imp, "to", "left").select("at", "to", (F.coalesce("w", F.lit(1.0)) * F.coalesce("importance", F.lit(0.5)) * decay).alias("factor"))

    steps, acyclic = Sought(factors, "at", "impact-steps"), False
    frontier, found = measured(seeds.select("id").distinct().withColumn("score", F.lit(start)), "impact-0")
    best, k = frontier, 0
    while True:
        k += 1
        new = steps.meets(frontier, "id", found["n"]).select(F.col("to").alias("id"), (F.col("score") * F.col("factor")).alias("score"), "factor").where(F.col("score") >= floor).groupBy("id").agg(F.max("score").alias("score"), F.max("factor").alias("factor"))
        old = best.groupBy("id").agg(F.max("score").alias("old"))
        frontier, found = measured(new.join(old, "id", "left").where("old is null or score > old").select("id", "score", "factor"), f"impact-{k}", factor=F.max("factor"))
        if not found["n"]:
            break
        if (found["factor"] or 0.0) > 1.0 and not acyclic:
            acyclic = on_cycles(edges.select("src", "dst")).isEmpty()
            if not acyclic:
                raise ValueError("a factor above 1 on a graph with cycles: scores would rise without end")
        frontier = frontier.select("id", "score")
        best = best.unionByName(frontier)
    steps.unpersist()
    return best.groupBy("id").agg(F.max("score").alias("score"))


def linked(nodes: DataFrame, pairs: DataFrame, *values: str) -> tuple[DataFrame, int]:
    """(n, _slice, links): for each node the nodes that its pairs (src, dst, values) lead to, by number (nodes: id, n), and how many partitions these rows are in; ends that are no nodes are left out.

    Rounds then exchange numbers in place of ids and neither sort nor exchange pairs. A node of over HEAVY pairs, a hub, has
    several rows. Partitions are as few as cores, so that what is summed before an exchange is summed over many pairs, but of
    PAIRS at most.
    """
    a, b = nodes.select(F.col("id").alias("src"), "n"), nodes.select(F.col("id").alias("dst"), F.col("n").alias("to"))
    numbered, found = measured(pairs.join(a, "src").join(b, "dst").select("n", "to", *values), "links")
    counts = numbered.groupBy("n").agg(F.count("*").alias("_n")).where(F.col("_n") > HEAVY)
    heavy, hubs = measured(counts.select(F.col("n").alias("_heavy"), F.ceil(F.col("_n") / HEAVY).alias("_slices")), "heavy")
    part = F.lit(0).cast("long")
    if hubs["n"]:
        numbered = numbered.join(F.broadcast(heavy), F.col("n") == F.col("_heavy"), "left")
        part = F.coalesce(F.pmod(F.xxhash64("to"), F.col("_slices")), F.lit(0).cast("long"))
    partitions = max(numbered.sparkSession.sparkContext.defaultParallelism, -(-found["n"] // PAIRS))
    rows = numbered.withColumn("_slice", part).groupBy("n", "_slice").agg(F.collect_list(F.struct("to", *values)).alias("links"))
    return settled(rows.repartition(partitions, "n"), "linked"), partitions


def numbers(vertices: DataFrame) -> tuple[DataFrame, int]:
    """(id, n): the distinct ids, each with a number, in the order of the ids; and how many there are."""
    nodes, found = measured(vertices.select("id").distinct().orderBy("id").withColumn("n", F.monotonically_increasing_id()), "numbers")
    return nodes, found["n"]


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(id, pagerank): one term for each edge row, weighted by the first row of its pair, by the source's number of rows; what dangling nodes hold is spread evenly. Weights below 1 lose mass, and ranks aren't normalised again.

    From the second round on it ends as soon as ranks change by less than the tolerance in sum. A round is one write: how far
    ranks moved and what dangling nodes hold are summed on the way.
    """
    nodes, n = numbers(vertices)
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    pair = settled(edges.groupBy("src", "dst").agg(F.count("*").alias("rows"), F.min_by("weight", "pos").alias("w")), "pagerank-pairs")
    out = settled(pair.groupBy("src").agg(F.sum("rows").alias("out")), "pagerank-out")
    ranks, found = measured(nodes.join(out.select(F.col("src").alias("id"), F.lit(True).alias("_out")), "id", "left").select("n", F.col("_out").isNull().alias("dangling"), F.lit(1.0 / n).alias("pagerank")), "pagerank-ids", dangling=F.count_if("dangling"))
    links, partitions = linked(nodes, pair.join(out, "src").select("src", "dst", (F.col("rows") * F.col("w") / F.col("out")).alias("share")), "share")
    links = links.repartition(partitions, "n").persist(StorageLevel.MEMORY_AND_DISK)
    lost = found["dangling"] / n
    for k in range(rounds):
        sent = links.join(ranks.select("n", "pagerank").repartition(partitions, "n").hint("shuffle_hash"), "n").select("pagerank", F.inline("links"))
        into = sent.groupBy(F.col("to").alias("n")).agg(F.sum(F.col("pagerank") * F.col("share")).alias("got"))
        new = ranks.withColumnRenamed("pagerank", "_old").join(into, "n", "left").select("n", "dangling", "_old", ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0)) + damping * F.lit(lost) / n).alias("pagerank"))
        figures = {"lost": F.sum(F.when(F.col("dangling"), F.col("pagerank")))}
        if k > 0 and tolerance > 0:
            figures["moved"] = F.sum(F.abs(F.col("pagerank") - F.col("_old")))
        ranks, found = measured(new, f"pagerank-{k}", **figures)
        ranks, lost = ranks.select("n", "dangling", "pagerank"), found["lost"] or 0.0
        if found.get("moved", tolerance) < tolerance:
            break
    links.unpersist()
    return nodes.join(ranks, "n").select("id", "pagerank")


def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label): synchronous rounds; each node takes the commonest label among its distinct neighbours both ways and itself, the least on ties. It ends early when no label changes.

    Labels are numbers in the order of the ids, so the least number is the least id.
    """
    nodes, n = numbers(vertices)
    either = edges.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    own = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    links, partitions = linked(nodes, either.union(own).distinct())
    links = links.repartition(partitions, "n").persist(StorageLevel.MEMORY_AND_DISK)
    labels = nodes.select("n", F.col("n").alias("label"))
    for k in range(rounds):
        # A node is among its own voters, so its label before comes along.
        sent = links.join(labels.repartition(partitions, "n").hint("shuffle_hash"), "n").select("n", "label", F.inline("links"))
        votes = sent.groupBy("to", "label").agg(F.count("*").alias("votes"), F.max(F.when(F.col("to") == F.col("n"), F.col("label"))).alias("own"))
        new = votes.groupBy(F.col("to").alias("n")).agg(F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("label"), F.max("own").alias("own"))
        labels, found = measured(new, f"labels-{k}", changed=F.count_if(F.col("label") != F.col("own")))
        labels = labels.select("n", "label")
        if not found["changed"]:
            break
    links.unpersist()
    return nodes.join(labels, "n").join(nodes.select(F.col("n").alias("label"), F.col("id").alias("_label")), "label").select("id", F.col("_label").alias("label"))


def communities(labels: DataFrame, vertices: DataFrame, most: int = 10, members: int = 5) -> DataFrame:
    """(label, size, id, place): the largest communities and the most important members of each."""
    top = labels.groupBy("label").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "label").limit(most)
    w = Window.partitionBy("label").orderBy(F.desc("importance"), "id")
    return labels.join(top, "label").join(vertices.select("id", "importance"), "id").withColumn("place", F.row_number().over(w)).where(F.col("place") <= members).select("label", "size", "id", "place")


def cross_edges(labels: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """(from_label, to_label, n, weight) between communities, the most frequent ones."""
    a, b = labels.toDF("src", "from_label"), labels.toDF("dst", "to_label")
    return edges.join(a, "src").join(b, "dst").where("from_label <> to_label").groupBy("from_label", "to_label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).orderBy(F.desc("n"), "from_label", "to_label").limit(most)


def paths(edges: DataFrame, starts: DataFrame, hops: int, stop: DataFrame | None = None) -> DataFrame:
    """(path) of every simple path of 1 to `hops` edges from the starts; with stop, no path goes past one of those."""
    steps = edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to")).distinct()
    now = starts.select(F.array("id").alias("path")).distinct()
    out = None
    ends = stop.select(F.col("id").alias("_end")).distinct() if stop is not None else None
    for k in range(hops):
        last = F.element_at("path", -1)
        open_ = now if ends is None else now.join(ends, last == F.col("_end"), "left_anti")
        now, found = measured(open_.join(steps, last == F.col("_at")).where(~F.array_contains("path", F.col("_to"))).select(F.concat("path", F.array("_to")).alias("path")), f"paths-{k}")
        out = now if out is None else out.unionByName(now)
        if not found["n"]:
            break
    return out


def important_paths(vertices: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """Paths of at most three nodes from the most important vertices."""
    top = vertices.orderBy(F.desc("importance"), "id").limit(n)
    return paths(edges, top, 2)


def sampled_paths(vertices: DataFrame, edges: DataFrame, kept: DataFrame, hops: int = 3, most: int = 10) -> DataFrame:
    """Paths over Calls within the kept nodes, the first by their text."""
    inner = internal_edges(kept, edges.where("edge_type = 'Calls'"))
    return paths(inner, kept, hops).select(F.array_join("path", " > ").alias("path")).distinct().orderBy("path").limit(most)


def call_chain(vertices: DataFrame, edges: DataFrame, start: str, end: str | None = None, upstream: bool = False, depth: int = 8, most: int = 20) -> DataFrame:
    """(path) of call chains from the functions of a name, with node names: to a name, each as soon as it is reached; else those that can't go on or have reached depth + 1 nodes. Sorted, each once, the first so many."""
    calls = edges.where("edge_type = 'Calls'")
    calls = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if upstream else calls.select("src", "dst")
    starts = vertices.where(F.col("name") == start)
    names = vertices.select(F.col("id"), "name")
    if end is not None:
        ends = vertices.where(F.col("name") == end)
        found = paths(calls, starts, depth, ends)
        found = found.join(ends.select(F.col("id").alias("_end")), F.element_at("path", -1) == F.col("_end"), "left_semi")
        if start == end:
            found = starts.select(F.array("id").alias("path"))
    else:
        every = starts.select(F.array("id").alias("path")).unionByName(paths(calls, starts, depth))
        steps = calls.select(F.col("src").alias("_at"), F.col("dst").alias("_to")).distinct()
        more = every.where(F.size("path") <= depth).join(steps, F.element_at("path", -1) == F.col("_at")).where(~F.array_contains("path", F.col("_to"))).select("path").distinct()
        found = every.join(more, "path", "left_anti")
    exploded = found.select(F.array_join("path", "\x1f").alias("key"), F.posexplode("path").alias("k", "id")).join(names, "id")
    shown = exploded.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), " -> ").alias("path"))
    return shown.select("path").distinct().orderBy("path").limit(most)


def seeds_of_paths(vertices: DataFrame, changed: DataFrame, most: int = 200, fallback: int = 20) -> DataFrame:
    """(id): vertices whose file path ends with a changed path, the first so many; the most important ones where there is none.

    A path is cut to the lengths that changed paths have, so the join is by equality.
    """
    wanted = changed.select(F.col("path").alias("_path")).where("_path <> ''").distinct()
    sizes = wanted.agg(F.collect_set(F.length("_path")).alias("_sizes"))
    tails = vertices.crossJoin(F.broadcast(sizes)).select("id", F.explode(F.transform(F.filter("_sizes", lambda n: n <= F.length("file_path")), lambda n: F.right(F.col("file_path"), n))).alias("_path"))
    hit = tails.join(wanted, "_path").select("id").distinct().orderBy("id").limit(most)
    return vertices.orderBy(F.desc("importance"), "id").select("id").limit(fallback) if hit.isEmpty() else hit


def top_ranked(ranks: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """The k highest ranks of the kept nodes."""
    return ranks.join(kept.select("id"), "id", "left_semi").orderBy(F.desc("pagerank"), "id").limit(k)
