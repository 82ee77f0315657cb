"""Q: the generic query representation."""

from pyspark.sql import functions as F

from ..operators import ops
from ..plans.query import Criteria, Filter, Page, add_tag, all_of, any_of, coalesced, contains_point, has_tag, history, none_of, overlapping_pairs, remove_tag
from .bindings import ctes
from .registry import query

_ops = {"eq": ("p_size", 10), "ne": ("p_size", 10), "contains": ("p_type", "TIN"), "gt": ("p_size", 40), "lt": ("p_size", 5), "ge": ("p_size", 45), "le": ("p_size", 3), "in": ("p_size", (1, 2, 3)), "not_in": ("p_size", tuple(range(1, 45))), "is_null": ("p_brand", None), "is_not_null": ("p_brand", None)}
_sql = {"eq": "p_size = 10", "ne": "p_size <> 10", "contains": "contains(p_type, 'TIN')", "gt": "p_size > 40", "lt": "p_size < 5", "ge": "p_size >= 45", "le": "p_size <= 3", "in": "p_size IN (1, 2, 3)", "not_in": f"p_size NOT IN {tuple(range(1, 45))}", "is_null": "p_brand IS NULL", "is_not_null": "p_brand IS NOT NULL"}


@query("q01_ops", " UNION ALL ".join(f"SELECT '{k}' AS operator, count(*) AS n, CAST(coalesce(sum(p_partkey), 0) AS BIGINT) AS keys FROM part WHERE {s}" for k, s in _sql.items()))
def q01(i):
    p = i.table("part")
    out = None
    for name, (column, value) in _ops.items():
        part = Criteria([Filter(column, name, value)]).apply(p).agg(F.count("*").alias("n"), F.coalesce(F.sum("p_partkey"), F.lit(0)).cast("long").alias("keys")).select(F.lit(name).alias("operator"), "n", "keys")
        out = part if out is None else out.unionByName(part)
    return out


@query("q02_and", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_size <= 30 AND contains(p_type, 'COPPER') AND p_brand IN ('Brand#12', 'Brand#23', 'Brand#34')")
def q02(i):
    return Criteria([Filter("p_size", "gt", 10), Filter("p_size", "le", 30), Filter("p_type", "contains", "COPPER"), Filter("p_brand", "in", ("Brand#12", "Brand#23", "Brand#34"))]).apply(i.table("part")).select("p_partkey")


@query("q03_sort", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey LIMIT 50")
def q03(i):
    return Criteria(sorts=[("p_brand", True), ("p_size", False), ("p_partkey", True)], page=Page(1, 50)).apply(i.table("part")).select("p_partkey", "p_brand", "p_size")


@query("q04_page", "SELECT o_orderkey, (SELECT CAST(ceil(count(*) / 25) AS BIGINT) FROM orders WHERE o_orderstatus = 'O') AS total_pages FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def q04(i):
    page = Page(3, 25)
    c = Criteria([Filter("o_orderstatus", "eq", "O")], [("o_totalprice", False), ("o_orderkey", True)], page)
    n = Criteria(c.filters).apply(i.table("orders")).count()
    return c.apply(i.table("orders")).select("o_orderkey", F.lit(page.total_pages(n)).cast("long").alias("total_pages"))


@query("q05_literals", "SELECT o_orderkey FROM orders WHERE contains(o_orderpriority, '-') AND o_orderpriority <> '5-LOW''s %_x'")
def q05(i):
    return Criteria([Filter("o_orderpriority", "contains", "-"), Filter("o_orderpriority", "ne", "5-LOW's %_x")]).apply(i.table("orders")).select("o_orderkey")


@query("q06_algebra", "SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT (p_brand = 'Brand#11' OR p_retailprice > 1500)")
def q06(i):
    c = F.col
    return i.table("part").where(all_of(any_of(c("p_size") < 5, c("p_size") > 45), none_of(c("p_brand") == "Brand#11", c("p_retailprice") > 1500))).select("p_partkey")


_f = f"WITH {ctes('functions')}"


@query("q07_contains", f"{_f} SELECT file_path, ord FROM functions WHERE 500 BETWEEN line_start AND line_end")
def q07c(i):
    return i.bind("functions").where(contains_point(F.col("line_start"), F.col("line_end"), F.lit(500))).select("file_path", "ord")


@query("q07_overlap", f"{_f} SELECT a.file_path, a.ord AS left_id, b.ord AS right_id FROM functions a JOIN functions b ON a.file_path = b.file_path AND a.ord < b.ord AND a.line_start <= b.line_end AND b.line_start <= a.line_end")
def q07(i):
    return overlapping_pairs(i.bind("functions"), "file_path", "ord")


@query("q07_coalesce", f"""{_f}, m AS (SELECT *, max(line_end) OVER (PARTITION BY file_path ORDER BY line_start, line_end, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM functions),
k AS (SELECT *, sum(CASE WHEN b IS NULL OR line_start > b THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY line_start, line_end, ord ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT file_path, min(line_start) AS start, max(line_end) AS end, count(*) AS n FROM k GROUP BY file_path, g""")
def q07m(i):
    return coalesced(i.bind("functions"), "file_path")


@query("q08_version", f"WITH {ctes('services')}, v AS (SELECT service, [CAST(x AS INTEGER) FOR x IN string_split(version, '.')] AS v FROM services) SELECT service, v[1] AS major, v[2] AS minor, v[3] AS patch, v[1] = 1 AND v >= [1, 2, 0] AS compatible FROM v")
def q08(i):
    v = ops.version(F.col("version"))
    return i.bind("services").select("service", v.alias("v")).select("service", "v.major", "v.minor", "v.patch", ops.compatible(F.col("v"), F.struct(F.lit(1).alias("major"), F.lit(2).alias("minor"), F.lit(0).alias("patch"))).alias("compatible"))


@query("q09_tags", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN ['b', 'c'] WHEN p_size % 3 = 1 THEN ['b'] ELSE ['b', 'x'] END AS tags, p_size % 3 = 2 AS has_x FROM part")
def q09(i):
    k = F.col("p_size") % 3
    tags = F.when(k == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).when(k == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("x")))
    return i.table("part").select("p_partkey", remove_tag(add_tag(tags, "b"), "a").alias("tags"), has_tag(tags, "x").alias("has_x"))


@query("q10_history", "SELECT event_id FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00' AND regexp_matches(event_type, 'click|view') ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 2")
def q10(i):
    commits = i.table("events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("author"), "ts", F.col("event_type").alias("message"))
    return history(commits, "7", F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'"), F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'"), "click|view", 2, 10).select(F.col("id").alias("event_id"))
