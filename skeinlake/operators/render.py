"""Text from graphs and series: DOT, Mermaid, ASCII, Markdown, HTML, templates.

Lines come as rows with a place, so a large graph is written by many tasks; whole documents are built of bounded tables only.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Mapping, Sequence
from html import escape
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookups import case

SHAPES = {"Function": "ellipse", "Class": "box", "Module": "folder", "File": "note"}
COLOURS = {"Calls": "blue", "Imports": "green", "Exports": "orange", "Contains": "gray", "Inherits": "purple", "DependsOn": "brown"}
ARROWS = {"Calls": "-->", "Imports": "-.->", "Exports": "==>", "Contains": "---", "DependsOn": "-.->"}


def label(node_type: Column, name: Column) -> Column:
    return F.when(node_type == "Function", F.concat(F.lit("fn "), name, F.lit("()"))).when(node_type == "Class", F.concat(F.lit("class "), name)).when(node_type == "Module", F.concat(F.lit("mod "), name)).otherwise(F.concat(F.lit("file "), name))


def dot_lines(vertices: DataFrame, edges: DataFrame, highlighted: DataFrame | None = None, weights: bool = False) -> DataFrame:
    """(part, key, line) of a DOT file in the order of part and key: nodes by id, edges by their ends."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    v = vertices if highlighted is None else vertices.join(highlighted.select("id", F.lit(True).alias("_hot")), "id", "left")
    hot = F.lit("") if highlighted is None else F.when(F.col("_hot"), ', color="red", penwidth=2').otherwise("")
    nodes = v.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  "), quoted(F.col("id")), F.lit(" [label="), quoted(label(F.col("node_type"), F.col("name"))), F.lit(", shape="), case(F.col("node_type"), SHAPES, "ellipse"), hot, F.lit("];")).alias("line"))
    weight = F.concat(F.lit(', weight="'), F.format_string("%.2f", "weight"), F.lit('"')) if weights else F.lit("")
    links = edges.select(F.lit(2).alias("part"), F.concat_ws("\x1f", "src", "dst", "edge_type").alias("key"), F.concat(F.lit("  "), quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(' [label="'), F.col("edge_type"), F.lit('", color="'), case(F.col("edge_type"), COLOURS, "black"), F.lit('"'), weight, F.lit("];")).alias("line"))
    frame = vertices.sparkSession.createDataFrame([(0, "", "digraph G {"), (3, "", "}")], "part int, key string, line string")
    return frame.unionByName(nodes).unionByName(links)


def numbered(vertices: DataFrame) -> DataFrame:
    """Vertices with a place by id, from 0. Numbers are shown to people, so this is for graphs of a size that is drawn: one task numbers them."""
    return vertices.withColumn("n", F.row_number().over(Window.orderBy("id")) - 1)


def mermaid_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, line) of a Mermaid flowchart with short node ids."""
    v = numbered(vertices).select("id", "n", label(F.col("node_type"), F.col("name")).alias("label"))
    nodes = v.select(F.lit(1).alias("part"), F.lpad(F.col("n").cast("string"), 12, "0").alias("key"), F.concat(F.lit("  N"), F.col("n").cast("string"), F.lit('["'), F.replace("label", F.lit('"'), F.lit("'")), F.lit('"]')).alias("line"))
    a, b = v.select(F.col("id").alias("src"), F.col("n").alias("a")), v.select(F.col("id").alias("dst"), F.col("n").alias("b"))
    links = edges.join(a, "src").join(b, "dst").select(F.lit(2).alias("part"), F.concat_ws("\x1f", "src", "dst", "edge_type").alias("key"), F.concat(F.lit("  N"), F.col("a").cast("string"), F.lit(" "), case(F.col("edge_type"), ARROWS, "-->"), F.lit(" N"), F.col("b").cast("string")).alias("line"))
    return vertices.sparkSession.createDataFrame([(0, "", "flowchart TD")], "part int, key string, line string").unionByName(nodes).unionByName(links)


def ascii_lines(vertices: DataFrame, edges: DataFrame, verbosity: int = 1) -> DataFrame:
    """(part, key, line): N0 [label] of each node, and N0 -> N1 (type) of each edge; file and importance from verbosity 2 on."""
    v = numbered(vertices)
    detail = F.concat(F.lit(" @ "), F.coalesce("file_path", F.lit("-")), F.lit(" importance="), F.format_string("%.2f", "importance")) if verbosity >= 2 else F.lit("")
    nodes = v.select(F.lit(0).alias("part"), F.lpad(F.col("n").cast("string"), 12, "0").alias("key"), F.concat(F.lit("N"), F.col("n").cast("string"), F.lit(" ["), label(F.col("node_type"), F.col("name")), F.lit("]"), detail).alias("line"))
    a, b = v.select(F.col("id").alias("src"), F.col("n").alias("a")), v.select(F.col("id").alias("dst"), F.col("n").alias("b"))
    links = edges.join(a, "src").join(b, "dst").select(F.lit(1).alias("part"), F.concat_ws("\x1f", "src", "dst", "edge_type").alias("key"), F.concat(F.lit("N"), F.col("a").cast("string"), F.lit(" -> N"), F.col("b").cast("string"), F.lit(" ("), "edge_type", F.lit(")")).alias("line"))
    return nodes.unionByName(links)


def document(lines: DataFrame) -> str:
    """The lines in order, as one text; for graphs of a size that is drawn."""
    return "\n".join(r["line"] for r in lines.orderBy("part", "key").select("line").toLocalIterator())


def image(dot: str, path: str, kind: str = "svg") -> str:
    """Draws a DOT text as an image (png, svg or pdf) by the program `dot`, and gives the image's path. Without that program the text itself is kept beside the path, and it raises."""
    if kind not in ("png", "svg", "pdf"):
        raise ValueError(f"{kind} is none of png, svg, pdf")
    Path(path).with_suffix(".dot").write_text(dot)
    if not shutil.which("dot"):
        raise RuntimeError("the program dot isn't installed; the text is kept as .dot")
    subprocess.run(["dot", f"-T{kind}", "-o", path], input=dot, text=True, check=True, timeout=300)
    return path


def bar_chart(series: DataFrame, by: str, order: str, value: str, width: int = 50, rows: int = 11) -> DataFrame:
    """(by, row, line): a bar chart of each series, at most `width` columns by the nearest sample (index j * n / width), rows from the greatest value down to 0."""
    w = Window.partitionBy(by).orderBy(order)
    n = F.count("*").over(Window.partitionBy(by))
    numbered_ = series.select(by, F.col(value).cast("double").alias("v"), (F.row_number().over(w) - 1).alias("i"), n.alias("n"), F.max(F.col(value).cast("double")).over(Window.partitionBy(by)).alias("top"))
    # A sample is shown in column j where i is the whole part of j * n / width; short series show each once.
    columns = F.when(F.col("n") <= width, F.array("i")).otherwise(F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.floor(j * F.col("n") / width) == F.col("i")))
    cells = numbered_.select(by, "v", "top", F.explode(columns).alias("j"))
    ranks = cells.select(by, "v", "top", "j", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"))
    mark = F.when(F.col("v") >= F.col("top") * (rows - 1 - F.col("row")) / (rows - 1), "#").otherwise(" ")
    return ranks.groupBy(by, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", mark.alias("m")))), lambda x: x["m"]), "").alias("line"))


def template(text: Column, values: Mapping[str, Column]) -> Column:
    """Each {key} of a text replaced by its value."""
    for key, value in values.items():
        text = F.replace(text, F.lit("{" + key + "}"), value)
    return text


def table(rows: Sequence, columns: Sequence[str]) -> str:
    """A Markdown table of rows already bounded."""
    show = lambda v: f"{v:.2f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows)])


def trend_report(snapshots: DataFrame, branch: str, last: int = 20) -> str:
    """A Markdown report of a branch: overview, trends, findings, advice, prediction, anomalies, chart, history."""
    from . import trends as t

    s = snapshots.where(F.col("branch") == branch)
    rates = t.change_rates(t.first_last(s, "branch"))
    part = lambda title, body: f"## {title}\n\n{body or 'none'}\n"
    rows = t.listed(s, last).select("ts", "commit_hash", "debt", "complexity", "stability").collect()
    overall = t.overall_trend(rates, "branch").collect()
    shown = lambda df, columns, order: table(df.orderBy(*order).limit(50).collect(), columns)
    chart = "\n".join(r["line"] for r in bar_chart(s, "branch", "ts", "debt").orderBy("row").collect())
    return "\n".join(
        [
            f"# Quality of {branch}\n", part("Overview", f"{s.count()} snapshots"), part("Overall trend", overall[0]["overall"] if overall else "too few snapshots"), part("Trends", shown(rates, ["metric", "first", "last", "rate", "direction"], ["metric"])),
            part("Findings", shown(t.key_findings(s, rates, "branch"), ["finding", "value"], ["finding"])), part("Advice", shown(t.trend_advice(rates, "branch"), ["metric", "advice"], ["metric"])), part("Prediction", shown(t.predictions(s, "branch"), ["days_to_critical", "next_complexity", "confidence"], ["branch"])),
            part("Anomalies", shown(t.anomalies(s, "branch"), ["ts", "metric", "value", "expected"], ["ts", "metric"])), part("Debt", f"```\n{chart}\n```"), part("History", table(rows, ["ts", "commit_hash", "debt", "complexity", "stability"])),
        ]
    )


def html_page(title: str, body: str) -> str:
    return f"<!DOCTYPE html>\n<html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><pre>{escape(body)}</pre></body></html>"


def impact_report(impacts: DataFrame, paths: DataFrame, top: int = 10) -> str:
    """Markdown of an impact scope: the strongest direct and indirect ones, the critical paths, advice by how many there are."""
    best = lambda cond: impacts.where(cond).orderBy(F.desc("score"), "id").limit(top).collect()
    direct, rest = best("depth = 1"), best("depth > 1")
    ways = [" > ".join(r["path"]) for r in paths.limit(top).collect()]
    advice = "split the change" if len(direct) + len(rest) >= top else "run the tests of the impacted parts" if direct else "no impact found"
    return "\n\n".join([f"# Impact\n\nDirect:\n\n{table(direct, ['id', 'score'])}", f"Indirect:\n\n{table(rest, ['id', 'score', 'depth'])}", "Paths:\n\n" + "\n".join(f"* {w}" for w in ways), f"Advice: {advice}"])


def change_report(changes: DataFrame, condensed: bool = False, most: int = 200) -> str:
    """Changes (change_id, change_type, component, risk) by risk, the worst first; condensed: Critical and High only."""
    levels = ["Critical", "High"] if condensed else ["Critical", "High", "Medium", "Low"]
    parts = []
    for level in levels:
        rows = changes.where(F.col("risk") == level).orderBy("change_id").limit(most).collect()
        if rows:
            parts.append(f"## {level} ({len(rows)})\n" + "\n".join(f"* {r['change_type']}: {r['component']}" for r in rows))
    return "\n\n".join(parts) or "no changes"


def insight_report(hotspots: DataFrame, violations: DataFrame, api: DataFrame, top: int = 10) -> str:
    spots = hotspots.orderBy(F.desc("score"), "name", "ord").limit(top).collect()
    return f"# Insights\n\nHotspots:\n\n{table(spots, ['name', 'score'])}\n\nViolations: {violations.count()}\n\nPublic functions: {api.count()}"
