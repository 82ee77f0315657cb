"""The driver's tables as inputs of the engine. Each is one SQL text that both dialects read, so query and oracle start from the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Spark:
    explode, array, size = "explode", "array", "size"
    days = staticmethod(lambda c: f"datediff({c}, DATE '1995-01-01')")
    split = staticmethod(lambda c, p: f"split({c}, '{p}')")
    explode_pos = staticmethod(lambda c, rest, src: f"SELECT {rest}, pos + 1 AS pos, col AS line FROM (SELECT *, {c} AS parts_ FROM {src}) LATERAL VIEW posexplode(parts_) AS pos, col")
    at = staticmethod(lambda a, i: f"element_at({a}, {i})")
    newline = "chr(10)"
    day = staticmethod(lambda c: f"CAST({c} AS DATE)")


class Duck:
    explode, array, size = "unnest", "list_value", "len"
    days = staticmethod(lambda c: f"CAST(date_diff('day', DATE '1995-01-01', CAST({c} AS DATE)) AS INTEGER)")
    split = staticmethod(lambda c, p: f"string_split_regex({c}, '{p}')")
    explode_pos = staticmethod(lambda c, rest, src: f"SELECT {rest}, CAST(unnest(range(1, len(parts_) + 1)) AS INTEGER) AS pos, unnest(parts_) AS line FROM (SELECT *, {c} AS parts_ FROM {src})")
    at = staticmethod(lambda a, i: f"({a})[{i}]")
    newline = "chr(10)"
    day = staticmethod(lambda c: f"CAST({c} AS DATE)")


BINDINGS: dict[str, Callable] = {}


def binding(f: Callable) -> Callable:
    BINDINGS[f.__name__] = f
    return f


@binding
def trade_vertices(d):
    f = "CAST(0 AS INT) AS start_line, CAST(0 AS INT) AS end_line"
    return f"""
SELECT 'region:' || CAST(r_regionkey AS STRING) AS id, 'Module' AS node_type, r_name AS name, 'world' AS file_path, {f}, CAST(0.4 AS DOUBLE) AS importance FROM {{region}}
UNION ALL SELECT 'nation:' || CAST(n_nationkey AS STRING), 'File', n_name, 'region/' || CAST(n_regionkey AS STRING), CAST(0 AS INT), CAST(0 AS INT), CAST(0.5 AS DOUBLE) FROM {{nation}}
UNION ALL SELECT 'cust:' || CAST(c_custkey AS STRING), 'Function', c_name, 'nation/' || CAST(c_nationkey AS STRING), CAST(c_custkey % 100 AS INT), CAST(c_custkey % 100 + 10 AS INT),
  least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) + CASE WHEN c_acctbal > 5000 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) FROM {{customer}}
UNION ALL SELECT 'supp:' || CAST(s_suppkey AS STRING), 'Class', s_name, 'nation/' || CAST(s_nationkey AS STRING), CAST(s_suppkey % 100 AS INT), CAST(s_suppkey % 100 + 50 AS INT),
  least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) + CASE WHEN s_acctbal < 0 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN s_suppkey % 2 = 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) FROM {{supplier}}"""


@binding
def trade_edges(d):
    return """
SELECT 'region:' || CAST(n_regionkey AS STRING) AS src, 'nation:' || CAST(n_nationkey AS STRING) AS dst, 'Contains' AS edge_type, CAST(1 AS DOUBLE) AS weight, CAST(1 AS BIGINT) AS call_count, CAST(n_nationkey AS BIGINT) AS pos FROM {nation}
UNION ALL SELECT 'nation:' || CAST(c_nationkey AS STRING), 'cust:' || CAST(c_custkey AS STRING), 'Contains', CAST(1 AS DOUBLE), CAST(1 AS BIGINT), CAST(1000000000 AS BIGINT) + c_custkey FROM {customer}
UNION ALL SELECT 'nation:' || CAST(s_nationkey AS STRING), 'supp:' || CAST(s_suppkey AS STRING), 'Contains', CAST(1 AS DOUBLE), CAST(1 AS BIGINT), CAST(2000000000 AS BIGINT) + s_suppkey FROM {supplier}
UNION ALL SELECT 'cust:' || CAST(o_custkey AS STRING), 'supp:' || CAST(l_suppkey AS STRING), 'DependsOn', CAST(0.8 AS DOUBLE), count(*), CAST(1000000000000 AS BIGINT) + o_custkey * 1000000 + l_suppkey
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey"""


@binding
def flow_edges(d):
    return """
SELECT event_type AS src, nxt AS dst, 'Calls' AS edge_type, CAST(1 AS DOUBLE) AS weight, count(*) AS call_count, min(event_id) AS pos
FROM (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events}) WHERE nxt IS NOT NULL AND nxt <> event_type GROUP BY event_type, nxt"""


@binding
def flow_vertices(d):
    return """SELECT event_type AS id, 'Function' AS node_type, event_type AS name, 'flow' AS file_path, CAST(0 AS INT) AS start_line, CAST(0 AS INT) AS end_line, least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) + CAST(0.02 AS DOUBLE) * length(event_type)) AS importance FROM (SELECT DISTINCT event_type FROM {events})"""


@binding
def mesh_edges(d):
    """Customers on 400 nodes, with up to three edges each and many cycles."""
    return """SELECT src, dst, CASE WHEN min(k) = 2 THEN 'Imports' ELSE 'Calls' END AS edge_type, CAST(0.8 AS DOUBLE) AS weight, count(*) AS call_count, min(pos) AS pos FROM (
SELECT 'm:' || CAST(o_custkey % 400 AS STRING) AS src, 'm:' || CAST(((o_custkey % 400) * 31 + (o_orderkey % 3) * 17 + 3) % 400 AS STRING) AS dst, o_orderkey % 3 AS k, o_orderkey AS pos FROM {orders}) WHERE src <> dst GROUP BY src, dst"""


@binding
def mesh_vertices(d):
    return f"""SELECT id, 'Function' AS node_type, id AS name, 'mesh' AS file_path, CAST(0 AS INT) AS start_line, CAST(0 AS INT) AS end_line, least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) + CAST(0.08 AS DOUBLE) * length(id)) AS importance FROM (SELECT src AS id FROM ({mesh_edges(d)}) UNION SELECT dst FROM ({mesh_edges(d)}))"""


@binding
def links(d):
    return f"""SELECT DISTINCT 'page:' || CAST(page_id AS STRING) AS src, 'ref:' || href AS dst, page_id FROM (SELECT page_id, {d.explode}(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM {{pages}})"""


@binding
def web_edges(d):
    return f"""
SELECT 'host:' || regexp_extract(url, '://([^/]+)', 1) AS src, 'page:' || CAST(page_id AS STRING) AS dst, 'Contains' AS edge_type, CAST(1 AS DOUBLE) AS weight, CAST(1 AS BIGINT) AS call_count, page_id AS pos FROM {{pages}}
UNION ALL SELECT src, dst, 'Imports', CAST(0.8 AS DOUBLE), CAST(1 AS BIGINT), CAST(1000000000 AS BIGINT) + page_id FROM ({links(d)})"""


@binding
def web_vertices(d):
    z = "CAST(0 AS INT) AS start_line, CAST(0 AS INT) AS end_line"
    return f"""
SELECT id, CASE WHEN id LIKE 'host:%' THEN 'Module' WHEN id LIKE 'page:%' THEN 'File' ELSE 'Module' END AS node_type, id AS name, id AS file_path, {z}, CASE WHEN id LIKE 'page:%' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS importance
FROM (SELECT src AS id FROM ({web_edges(d)}) UNION SELECT dst FROM ({web_edges(d)}))"""


@binding
def paths(d):
    ext = "CASE p_partkey % 23 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.js' WHEN 3 THEN '.ts' WHEN 4 THEN '.java' WHEN 5 THEN '.go' WHEN 6 THEN '.c' WHEN 7 THEN '.cpp' WHEN 8 THEN '.RS' WHEN 9 THEN '.toml' WHEN 10 THEN '.json' WHEN 11 THEN '.png' WHEN 12 THEN '' WHEN 13 THEN '.tsx' WHEN 14 THEN '.h' WHEN 15 THEN '.rb' WHEN 16 THEN '.yaml' WHEN 17 THEN '.exe' WHEN 18 THEN '_test.go' WHEN 19 THEN '.spec.ts' WHEN 20 THEN '.md' WHEN 21 THEN '.jsx' ELSE '.cc' END"
    top = "CASE p_partkey % 13 WHEN 0 THEN 'target/debug' WHEN 1 THEN 'node_modules/lib' WHEN 2 THEN '.git/objects' WHEN 3 THEN 'tests/unit' WHEN 4 THEN 'src/.cache' WHEN 5 THEN 'vendor/x' WHEN 6 THEN 'build' ELSE 'src/core' END"
    return f"SELECT p_partkey AS file_id, {top} || '/' || 'm' || CAST(p_size AS STRING) || '/f' || CAST(p_partkey AS STRING) || {ext} AS path, CAST(p_retailprice * 1000 AS BIGINT) AS n_bytes FROM {{part}}"


@binding
def functions(d):
    """Orders as functions of their customer: a closed interval of days each."""
    return f"""SELECT 'cust:' || CAST(o_custkey AS STRING) AS file_path, 'f' || CAST(o_orderkey % 997 AS STRING) AS name, o_orderkey AS ord, {d.days('o_orderdate')} AS line_start, {d.days('o_orderdate')} + CAST(o_orderkey % 130 AS INT) AS line_end, CAST(o_orderkey % 9 AS INT) AS n_params,
  CASE o_orderstatus WHEN 'O' THEN 'public' WHEN 'F' THEN 'private' ELSE NULL END AS visibility, o_orderpriority = '1-URGENT' AS is_async FROM {{orders}}"""


@binding
def classes(d):
    return """SELECT 'nation:' || CAST(s_nationkey AS STRING) AS file_path, s_name AS name, s_suppkey AS ord, CAST(s_suppkey % 31 AS INT) AS n_methods, CAST(s_suppkey % 4 AS INT) AS n_implements, CASE WHEN s_suppkey % 3 = 0 THEN 'Supplier#' || CAST(s_suppkey % 7 AS STRING) END AS extends, s_acctbal < 0 AS is_abstract FROM {supplier}"""


@binding
def calls(d):
    """Line items as calls: the ship day is the line, the part number's remainder names the callee."""
    return f"""SELECT 'cust:' || CAST(o_custkey AS STRING) AS file_path, 'f' || CAST(l_partkey % 997 AS STRING) AS callee, {d.days('l_shipdate')} AS line, l_orderkey * 10 + l_linenumber AS call_id FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_linenumber <= 2"""


@binding
def signatures_before(d):
    return _signatures("o_orderdate < TIMESTAMP '1998-01-01 00:00:00'", d)


@binding
def signatures_after(d):
    return _signatures("o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'", d)


def _signatures(when, d):
    return f"""SELECT 'c' || CAST(o_custkey AS STRING) AS name, CAST(count(*) AS BIGINT) AS n_params, max(o_orderpriority) AS return_type, min(o_orderstatus) AS visibility, {d.array}(min(o_orderpriority), max(o_orderstatus)) AS parameters FROM {{orders}} WHERE {when} GROUP BY o_custkey"""


@binding
def changes(d):
    """Orders as structural changes of nine kinds."""
    kinds = ["FunctionRemoved", "FunctionAdded", "FunctionSignatureChanged", "ParameterCountChanged", "ReturnTypeChanged", "VisibilityChanged", "StructureChanged", "InterfaceChanged", "ModuleStructureChanged"]
    case = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(kinds))
    return f"""SELECT o_orderkey AS change_id, o_custkey AS review, CASE o_orderkey % 9 {case} END AS change_type, 'cust:' || CAST(o_custkey AS STRING) AS component FROM {{orders}} WHERE o_orderkey % 9 <> 0 OR o_custkey % 2 = 0"""


@binding
def findings(d):
    return """SELECT o_orderkey AS finding_id, o_custkey AS target, CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '4-NOT SPECIFIED' THEN 'Low' ELSE 'Info' END AS severity, CASE o_orderpriority WHEN '1-URGENT' THEN 'ERROR' WHEN '2-HIGH' THEN 'WARNING' WHEN '3-MEDIUM' THEN 'INFO' WHEN '4-NOT SPECIFIED' THEN 'error' ELSE 'other' END AS scanner_severity, CASE o_orderkey % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'performance' WHEN 2 THEN 'architecture' ELSE 'quality' END AS category, o_orderdate AS found_at, o_totalprice AS score FROM {orders}"""


@binding
def doc_lines(d):
    return d.explode_pos(d.split("text", "\\n" if d is Duck else "\\\\n"), "doc_id, lang", "{documents}")


@binding
def diff_lines(d):
    """A diff of each conversation: a header for every system turn, else added, removed and context lines made of its text."""
    return """SELECT conv_id AS diff_id, CAST(turn * 10 + k AS INT) AS pos,
  CASE WHEN k = 0 AND (role = 'system' OR turn = 0) THEN 'diff --git a/src/m' || CAST(conv_id % 17 AS STRING) || '_' || CAST(turn AS STRING) || ext || ' b/src/m' || CAST(conv_id % 17 AS STRING) || '_' || CAST(turn AS STRING) || ext
    WHEN k = 0 THEN ' ' || substr(text, 1, 20)
    WHEN k = 1 THEN '+++ b/src/m' || CAST(conv_id % 17 AS STRING)
    WHEN k = 2 THEN CASE turn % 6 WHEN 0 THEN '+pub fn handle_' || CAST(conv_id AS STRING) || '(x: i32) -> i32 {{' WHEN 1 THEN '+struct Item' || CAST(turn AS STRING) || ' {{' WHEN 2 THEN '+trait Shape' || CAST(conv_id AS STRING) || ' {{' WHEN 3 THEN '+class Node' || CAST(turn AS STRING) || '(Base):' WHEN 4 THEN '+def run_' || CAST(turn AS STRING) || '(self):' ELSE '+let v = ' || CAST(turn AS STRING) || ';' END
    WHEN k = 3 THEN CASE turn % 4 WHEN 0 THEN '-fn old_' || CAST(conv_id AS STRING) || '(y: u8) {{' WHEN 1 THEN '-    return;' WHEN 2 THEN '--- a/x' ELSE ' context' END
    ELSE CASE WHEN turn % 5 = 0 THEN '' ELSE ' }}' END END AS line
FROM (SELECT *, CASE conv_id % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.js' WHEN 3 THEN '.json' ELSE '.java' END AS ext FROM {conversations}) c CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks"""


@binding
def snapshots(d):
    """A snapshot of each day and event type (the branch)."""
    return f"""SELECT event_type AS branch, CAST({d.day('ts')} AS STRING) AS day, min(ts) AS ts, 'c' || CAST(min(event_id) AS STRING) AS commit_hash, avg(value) AS complexity, CAST(count(*) AS DOUBLE) AS debt, CAST(count(DISTINCT user_id) AS DOUBLE) AS stability, max(value) AS coupling, CAST(count(*) * 37 AS BIGINT) AS lines_of_code, CAST(count(*) % 4 AS BIGINT) AS cycles, CAST(count(DISTINCT user_id) AS BIGINT) AS public_apis FROM {{events}} GROUP BY event_type, {d.day('ts')}"""


@binding
def tool_calls(d):
    return """SELECT event_id AS call_id, event_type AS tool, value AS duration_ms, event_type <> 'error' AND event_id % 7 <> 0 AS ok, ts, user_id AS service FROM {events}"""


@binding
def services(d):
    return """SELECT 's' || CAST(p_partkey AS STRING) AS service, CAST(p_size % 4 AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) || '.' || CAST(p_partkey % 3 AS STRING) AS version, CASE WHEN p_partkey % 5 = 0 THEN 'Down' ELSE 'Up' END AS status, p_brand AS tool FROM {part}"""


@binding
def requirements(d):
    return """SELECT 's' || CAST(p_partkey AS STRING) AS service, 's' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS needs, '>=' || CAST(p_size % 3 AS STRING) || '.' || CAST(p_partkey % 5 AS STRING) || '.0' AS wanted, p_partkey % 4 = 0 AS optional FROM {part} WHERE p_partkey > 1"""


def text(name: str, dialect=Duck) -> str:
    """A binding's SQL for the oracle, over the driver's table names."""
    raw = BINDINGS[name](dialect)
    return raw.format(**{t: t for t in TABLES})


def ctes(*names: str) -> str:
    return ", ".join(f"{n} AS ({text(n)})" for n in names)


class Inputs:
    """The driver's tables of one scale, and the bindings over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def bind(self, name: str) -> DataFrame:
        raw = BINDINGS[name](Spark)
        used = {t: self.table(t) for t in TABLES if f"{{{t}}}" in raw}
        return self.spark.sql(raw, **used)

    @cached_property
    def trade(self) -> tuple[DataFrame, DataFrame]:
        return self.bind("trade_vertices"), self.bind("trade_edges")
