"""The graph summary: rank, seeds, neighbourhood, top nodes, communities, paths, cut to a budget of tokens."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import settled
from . import graph


@dataclass(frozen=True)
class Plan:
    """How much of each part a summary shows."""

    radius: int
    top: int
    communities: int
    paths: int
    seeds: int
    truncated: bool = False


def estimate(seeds: int, top: int, kept: int, communities: int, community_edges: int, path_nodes: int) -> int:
    """Characters that a summary takes."""
    return 400 + 40 * seeds + 60 * top + 8 * kept + 80 * communities + 50 * community_edges + 30 * path_nodes


def fit_budget(plan: Plan, tokens: int, sizes, least_chars: int = 2000, most_steps: int = 8) -> Plan:
    """Cuts a plan, one step at a time, until its estimate fits: radius to 1, then top to 150, communities to 5, paths to 3, seeds to 10. sizes(plan) gives the arguments of estimate; at most eight steps."""
    if tokens <= 0:
        return plan
    allowed = max(4 * tokens, least_chars)
    reduced = False
    for _ in range(most_steps):
        if estimate(**sizes(plan)) <= allowed:
            break
        if plan.radius > 1 and not reduced:
            plan, reduced = replace(plan, radius=1, truncated=True), True
        elif plan.top > 150:
            plan = replace(plan, top=150, truncated=True)
        elif plan.communities > 5:
            plan = replace(plan, communities=5, truncated=True)
        elif plan.paths > 3:
            plan = replace(plan, paths=3, truncated=True)
        elif plan.seeds > 10:
            plan = replace(plan, seeds=10, truncated=True)
        else:
            break
    return plan


def graph_summary(vertices: DataFrame, edges: DataFrame, changed: DataFrame | None = None, radius: int = 2, top: int = 200, communities: int = 10, paths: int = 5, tokens: int = 3000, rounds: int = 20) -> tuple[dict[str, DataFrame], Plan]:
    """The parts of a summary as tables, and the plan that fitted the budget. The graph is settled first, as each part reads it anew."""
    vertices, edges = settled(vertices, "summary-vertices"), settled(edges, "summary-edges")
    ranks = graph.pagerank(vertices, edges, rounds=rounds)
    none = vertices.sparkSession.createDataFrame([], "path string")
    seeds = graph.seeds_of_paths(vertices, none if changed is None else changed)
    n_seeds = min(seeds.count(), 20)
    labels = graph.label_propagation(vertices, edges)
    kept_at: dict[int, DataFrame] = {}
    counted: dict[int, int] = {}

    def kept(r: int) -> DataFrame:
        if r not in kept_at:
            kept_at[r] = graph.neighbourhood(edges, seeds, r).select("id")
            counted[r] = kept_at[r].count()
        return kept_at[r]

    sizes = lambda p: {"seeds": min(n_seeds, p.seeds), "top": min(p.top, counted[p.radius] if kept(p.radius) is not None else 0), "kept": counted[p.radius], "communities": p.communities, "community_edges": 2 * p.communities, "path_nodes": 4 * p.paths}
    plan = fit_budget(Plan(radius, top, communities, paths, 20), tokens, sizes)
    inside = kept(plan.radius)
    parts = {
        "top": graph.top_ranked(ranks, inside, plan.top), "seeds": seeds.orderBy("id").limit(plan.seeds), "statistics": graph.statistics(vertices, edges), "communities": graph.communities(labels, vertices, plan.communities),
        "community_edges": graph.cross_edges(labels, edges, 2 * plan.communities), "paths": graph.sampled_paths(vertices, edges, inside, 3, plan.paths),
    }
    return parts, plan


def as_rows(parts: dict[str, DataFrame], plan: Plan) -> DataFrame:
    """(section, json) of all parts, and the plan."""
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("json"))
        out = rows if out is None else out.unionByName(rows)
    return out.unionByName(out.sparkSession.createDataFrame([("plan", str(plan))], "section string, json string"))
