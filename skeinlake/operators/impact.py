"""Propagation of changes against the edges, critical paths and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookups import EDGE_FACTORS, NO_EDGE_FACTOR, TYPE_FACTORS, case
from ..plans.tables import Sought, measured, settled
from .graph import pairs_back


def edge_factor(edge_type: Column, default: float | None = None) -> Column:
    return case(edge_type, EDGE_FACTORS, default)


def steps_back(vertices: DataFrame, edges: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """(at, to, pos, factor, weight): from a node to each that depends on it; from the nodes (id) of `at`, or from all. The factor is of the first edge at -> to, else of the first to -> at."""
    pairs, ahead, known = pairs_back(vertices, edges, "edge_type", at)
    back = pairs.select(F.col("dst").alias("at"), F.col("src").alias("to"), "pos", F.col("edge_type").alias("back_type"))
    ahead = ahead.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("edge_type").alias("ahead_type"))
    v = known.select(F.col("id").alias("_id"), "importance", case(F.col("node_type"), TYPE_FACTORS, 1.0).alias("type_factor"))
    return (
        back.join(ahead, (F.col("at") == F.col("_s")) & (F.col("to") == F.col("_d")), "left").join(v, F.col("to") == F.col("_id"), "left")
        .select("at", "to", "pos", F.coalesce(edge_factor(F.col("ahead_type")), edge_factor(F.col("back_type")), F.lit(NO_EDGE_FACTOR)).alias("factor"), F.when(F.col("_id").isNull(), F.lit(0.5)).otherwise(F.col("importance") * F.col("type_factor")).alias("weight"))
    )


def step_score(parent: Column, depth: Column, factor: Column, importance: Column, type_factor: Column) -> Column:
    """The score of a step: the parent's, decayed by 0.8 to the power of the depth, times the factors."""
    return parent * F.pow(F.lit(0.8), depth) * factor * importance * type_factor


def hop_chance(factor: Column, importance: Column) -> Column:
    """The chance that a change goes on over a hop."""
    return factor * 0.85 * F.least(F.lit(1.0), 0.5 + 0.5 * importance)


def chain_severity(probability: Column, length: Column, central: Column) -> Column:
    """High, Medium or Low by a chain's probability, its nodes and the greatest centrality on it."""
    return F.when((probability > 0.8) | (length >= 5) | (central > 0.25), "High").when((probability > 0.6) | (length >= 4) | (central > 0.15), "Medium").otherwise("Low")


def propagate(vertices: DataFrame, edges: DataFrame, sources: DataFrame, depth: int = 3, least: float = 0.05) -> DataFrame:
    """(id, depth, score, kind) of nodes that a change of the sources reaches; sources are left out.

    Level by level; of several ways to a node at one level the first counts, by the order in which its parents were found and
    then the edges' order. A node that scores too little isn't seen, so a later level may still reach it.
    """
    steps = Sought(lambda at: steps_back(vertices, edges, at), "at", "propagate-steps")
    known = sources.select("id").distinct().join(vertices.select("id"), "id", "left_semi")
    # The order of discovery as a list of edge positions: lists compare as the visits came, without numbering all rows in one task.
    level, got = measured(known.select("id", F.lit(1.0).alias("score"), F.lit(0).alias("depth"), F.array(F.lit(0).cast("long")).alias("found")), "propagate-0")
    seen, out = level.select("id"), level.where("false")
    for d in range(1, depth + 1):
        score = F.col("score") * F.lit(0.8**d) * F.col("factor") * F.col("weight")
        near = steps.meets(level, "id", got["n"]).select(F.col("to").alias("id"), score.alias("score"), F.lit(d).alias("depth"), F.concat("found", F.array("pos")).alias("found"), F.col("at")).where(F.col("score") > least).join(seen, "id", "left_anti")
        pick = F.row_number().over(Window.partitionBy("id").orderBy("found", "at"))
        level, got = measured(near.withColumn("_k", pick).where("_k = 1").select("id", "score", "depth", "found"), f"propagate-{d}")
        if not got["n"]:
            break
        seen, out = seen.union(level.select("id")), out.unionByName(level)
    steps.unpersist()
    kind = F.when(F.col("depth") == 1, "Direct").when(F.col("score") > 0.5, "Transitive").otherwise("Conditional")
    return out.select("id", "depth", "score", kind.alias("kind"))


def scope(impacts: DataFrame, vertices: DataFrame, high: float = 0.7) -> DataFrame:
    """One row: direct and indirect counts, mean and greatest score, greatest depth, high scores, radius and adjusted radius."""
    n = vertices.agg(F.count("*").alias("n_nodes"))
    a = impacts.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.count_if(F.col("score") > high).alias("high"))
    radius = F.coalesce(F.try_divide(F.col("direct") + F.col("indirect"), F.col("n_nodes")), F.lit(0.0))
    return a.crossJoin(n).withColumn("radius", radius).withColumn("adjusted_radius", adjusted_radius(F.col("radius"), F.col("avg_score"), F.col("max_depth")))


def adjusted_radius(base: Column, avg: Column, depth: Column) -> Column:
    return F.least(F.lit(1.0), base + 0.3 * avg + 0.02 * depth)


def critical_paths(vertices: DataFrame, edges: DataFrame, sources: DataFrame, impacts: DataFrame, depth: int = 3, targets: int = 5, least: float = 0.8, keep: int = 5) -> DataFrame:
    """(source, target, path, weight): shortest ways to the best-scored nodes, of fewer hops than depth; the product of factors times 0.9 for each hop, above the least, the heaviest few."""
    steps = Sought(lambda at: steps_back(vertices, edges, at).select(F.col("at").alias("_at"), "to", "factor"), "_at", "critical-steps")
    best = impacts.orderBy(F.desc("score"), "id").limit(targets).select(F.col("id").alias("target"))
    level, got = measured(sources.select(F.col("id").alias("source"), F.col("id").alias("at"), F.array("id").alias("path"), F.lit(1.0).alias("weight")), "critical-0")
    seen, found = level.select("source", "at"), None
    for d in range(1, depth):
        near = steps.meets(level, "at", got["n"]).select("source", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), (F.col("weight") * F.col("factor") * 0.9).alias("weight")).join(seen, ["source", "at"], "left_anti")
        level, got = measured(near.withColumn("_k", F.row_number().over(Window.partitionBy("source", "at").orderBy("path"))).where("_k = 1").drop("_k"), f"critical-{d}")
        seen = seen.unionByName(level.select("source", "at"))
        hit = level.join(F.broadcast(best), F.col("at") == F.col("target")).select("source", "target", "path", "weight")
        found = hit if found is None else found.unionByName(hit)
    steps.unpersist()
    return found.where(F.col("weight") > least).orderBy(F.desc("weight"), "source", "target").limit(keep)


def find_components(vertices: DataFrame, name: str) -> DataFrame:
    """Vertices whose id is the name or ends with it, or of that name, or a module or file whose path ends with it; else those that contain it anywhere."""
    exact = vertices.where((F.col("id") == name) | F.col("id").endswith(name) | (F.col("name") == name) | (F.col("node_type").isin("Module", "File") & F.col("file_path").endswith(name)))
    if not exact.isEmpty():
        return exact
    return vertices.where(F.col("id").contains(name) | F.col("name").contains(name) | F.col("file_path").contains(name))


def cascades(vertices: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 4, probability: float = 0.3, shortest: int = 2, keep: int = 10, reverse_factor: bool = False) -> DataFrame:
    """(path, probability, severity) of simple chains against the edges, each hop with its own chance; chances only fall along a chain, so chains below the least are cut while they grow.

    The factor of a hop is looked up in the forward direction, 0.5 without an edge; reverse_factor takes the edge walked.
    """
    first = edges.groupBy("src", "dst").agg(F.min_by("edge_type", "pos").alias("edge_type"))
    ahead = first.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), edge_factor(F.col("edge_type"), 0.5).alias("f"))
    back = first.select(F.col("dst").alias("_at"), F.col("src").alias("_to"))
    on = (F.col("_at") == F.col("_d")) & (F.col("_to") == F.col("_s")) if reverse_factor else (F.col("_at") == F.col("_s")) & (F.col("_to") == F.col("_d"))
    n = vertices.agg(F.count("*").alias("n"))
    degree = edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count("*").alias("deg"))
    v = vertices.select("id", "importance").join(degree, "id", "left").crossJoin(F.broadcast(n)).select(F.col("id").alias("_v"), "importance", (F.coalesce("deg", F.lit(0)) / (2 * F.col("n"))).alias("centrality"))
    hops = settled(back.join(ahead, on, "left").join(v, F.col("_to") == F.col("_v"), "left").select("_at", "_to", hop_chance(F.coalesce("f", F.lit(0.5)), F.coalesce("importance", F.lit(0.5))).alias("p"), F.coalesce("centrality", F.lit(0.0)).alias("c")), "cascade-hops")
    begin = starts.select("id").distinct().join(v, F.col("id") == F.col("_v"), "left")
    now = begin.select(F.array("id").alias("path"), F.lit(1.0).alias("probability"), F.coalesce("centrality", F.lit(0.0)).alias("central"))
    out = None
    for k in range(depth):
        now = now.join(hops, F.element_at("path", -1) == F.col("_at")).where(~F.array_contains("path", F.col("_to"))).select(F.concat("path", F.array("_to")).alias("path"), (F.col("probability") * F.col("p")).alias("probability"), F.greatest("central", "c").alias("central")).where(F.col("probability") >= probability)
        now, found = measured(now, f"cascade-{k}")
        out = now if out is None else out.unionByName(now)
        if not found["n"]:
            break
    size = F.size("path")
    severity = chain_severity(F.col("probability"), size, F.col("central"))
    return out.where(size >= shortest).select("path", "probability", severity.alias("severity")).distinct().orderBy(F.desc("probability"), "path").limit(keep)


def chains(edges: DataFrame, starts: DataFrame, depth: int = 4) -> DataFrame:
    """All simple chains against the edges, of 1 to depth hops."""
    from .graph import paths

    return paths(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts, depth)


def review(vertices: DataFrame, edges: DataFrame, changed: DataFrame, threshold: float = 0.1, keep: int = 5) -> DataFrame:
    """(id, score, is_critical): the nodes most impacted by changed ones, with the best score of each."""
    from .graph import critical, weighted_impact

    seeds = vertices.join(changed.select("id").distinct(), "id", "left_semi")
    hot = critical(vertices, edges, threshold).select("id", F.lit(True).alias("is_critical"))
    scores = weighted_impact(vertices, edges, seeds).join(seeds.select("id"), "id", "left_anti")
    return scores.join(hot, "id", "left").select("id", "score", F.coalesce("is_critical", F.lit(False)).alias("is_critical")).orderBy(F.desc("score"), "id").limit(keep)


def condition(rule: dict) -> Column:
    """A rule's predicate over (edge_type, node_type, depth): {"all": [...]}, {"any": [...]}, {"edge": t}, {"node": t}, {"within": d}, or {} for always."""
    if "all" in rule:
        out = F.lit(True)
        for part in rule["all"]:
            out = out & condition(part)
        return out
    if "any" in rule:
        out = F.lit(False)
        for part in rule["any"]:
            out = out | condition(part)
        return out
    if "edge" in rule:
        return F.col("edge_type") == rule["edge"]
    if "node" in rule:
        return F.col("node_type") == rule["node"]
    if "within" in rule:
        return F.col("depth") <= rule["within"]
    return F.lit(True)
