"""X: structure from text."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from ..operators import extract, scan
from .bindings import ctes
from .registry import query

_langs = ("rs", "py", "js", "ts", "java", "go", "c", "cpp")
FN = f"WITH {ctes('functions', 'classes')}"


def _code(i):
    """A small source file for each part, in a language by its number."""
    k = F.col("p_partkey").cast("string")
    head = {
        "rs": 'concat("/// doc ", k, "\n// note\npub async fn f", k, "(a: i32, b: &str) -> i32 {\n    helper(a);\n    x.run(b)\n}\nstruct S", k, " {\n}\n")', "py": 'concat("# note ", k, "\nimport os.path\nclass C", k, "(Base, Mixin):\n    def f", k, "(self, a):\n        helper(a)\n        return 1\n\n    def g(self):\n        pass\n")',
        "js": 'concat("/** doc */\nfunction f", k, "(a, b) {\n  helper(a);\n}\nclass C", k, " extends Base {\n}\n")', "ts": 'concat("export function f", k, "(a: number): string {\n  helper(a);\n}\nclass C", k, " extends Base implements X, Y {\n}\n")',
        "java": 'concat("import java.util.List;\npublic class C", k, " extends Base implements X {\n  public int f", k, "(int a, int b) {\n    helper(a);\n  }\n}\n")', "go": 'concat("// Doc\nfunc F", k, "(a int) error {\n\thelper(a)\n}\ntype T", k, " struct {\n}\n")',
        "c": 'concat("#include <stdio.h>\nint f", k, "(int a, char *b) {\n  helper(a);\n  if (a) { b(); }\n}\nstruct s", k, " {\n};\n")', "cpp": 'concat("/// doc\nint f", k, "(int a) {\n  ns::helper(a);\n}\nclass C", k, " : public Base {\n};\n")',
    }
    content = None
    for n, lang in enumerate(_langs):
        text = F.expr(head[lang].replace("\n", "\\n").replace("\t", "\\t"))
        content = F.when(F.col("p_partkey") % 8 == n, text) if content is None else content.when(F.col("p_partkey") % 8 == n, text)
    ext = F.get(F.array(*[F.lit(x) for x in _langs]), (F.col("p_partkey") % 8).cast("int"))
    return i.table("part").withColumn("k", k).select(F.concat(F.lit("src/m"), k, F.lit("."), ext).alias("path"), content.alias("content"))


def _lines(i):
    return extract.code_lines(_code(i))


_case = lambda values, default="NULL": "CASE p_partkey % 8 " + " ".join(f"WHEN {n} THEN {v}" for n, v in values.items()) + f" ELSE {default} END"
_path = "'src/m' || p_partkey || '.' || " + _case({n: f"'{x}'" for n, x in enumerate(_langs)})
_language = _case({n: f"'{x}'" for n, x in enumerate("rust python javascript typescript java go c cpp".split())})


@query("x02_functions", f"""SELECT {_path} AS path, {_language} AS language, CASE WHEN p_partkey % 8 = 5 THEN 'F' ELSE 'f' END || p_partkey AS name, {_case({0: "['a: i32', 'b: &str']", 1: "['self', 'a']", 2: "['a', 'b']", 3: "['a: number']", 4: "['int a', 'int b']", 5: "['a int']", 6: "['int a', 'char *b']", 7: "['int a']"})} AS parameters, {_case({0: "'i32'", 3: "'string'", 5: "'error'"})} AS return_type, CASE WHEN p_partkey % 8 IN (0, 1, 3, 4, 5) THEN 'public' ELSE 'private' END AS visibility, p_partkey % 8 = 0 AS is_async, {_case({0: 3, 1: 4, 2: 2, 3: 1, 4: 3, 5: 2, 6: 2, 7: 2})} AS line_start, {_case({0: 6, 1: 7, 2: 4, 3: 3, 4: 5, 5: 4, 6: 5, 7: 4})} AS line_end FROM part
UNION ALL SELECT {_path}, 'python', 'g', ['self'], NULL, 'public', false, 8, 10 FROM part WHERE p_partkey % 8 = 1""")
def x02(i):
    return extract.functions(_lines(i))


@query("x03_classes", f"""SELECT {_path} AS path, {_case({0: "'S'", 5: "'T'", 6: "'s'"}, "'C'")} || p_partkey AS name, CASE WHEN p_partkey % 8 IN (1, 2, 3, 4, 7) THEN 'Base' END AS extends, {_case({1: "['Mixin']", 3: "['X', 'Y']", 4: "['X']"}, "CAST([] AS VARCHAR[])")} AS implements, {_case({0: 7, 1: 3, 2: 5, 3: 4, 4: 2, 5: 5, 6: 6, 7: 5})} AS line_start FROM part""")
def x03(i):
    return extract.classes(_lines(i)).select("path", "name", "extends", "implements", "line_start")


@query("x04_calls", f"""SELECT {_path} AS path, 'helper' AS callee, p_partkey % 8 = 7 AS is_method, {_case({0: 4, 1: 5, 2: 3, 3: 2, 4: 4, 5: 3, 6: 3, 7: 3})} AS line FROM part
UNION ALL SELECT {_path}, 'run', true, 5 FROM part WHERE p_partkey % 8 = 0 UNION ALL SELECT {_path}, 'b', false, 4 FROM part WHERE p_partkey % 8 = 6 UNION ALL SELECT {_path}, 'C' || p_partkey, false, 3 FROM part WHERE p_partkey % 8 = 1""")
def x04(i):
    return extract.calls(_lines(i))


@query("x05_comments", f"""SELECT {_path} AS path, '/// doc ' || p_partkey AS text, 1 AS line, true AS is_doc FROM part WHERE p_partkey % 8 = 0 UNION ALL SELECT {_path}, '// note', 2, false FROM part WHERE p_partkey % 8 = 0 UNION ALL SELECT {_path}, '# note ' || p_partkey, 1, false FROM part WHERE p_partkey % 8 = 1
UNION ALL SELECT {_path}, '/** doc */', 1, true FROM part WHERE p_partkey % 8 = 2 UNION ALL SELECT {_path}, '// Doc', 1, true FROM part WHERE p_partkey % 8 = 5 UNION ALL SELECT {_path}, '/// doc', 1, true FROM part WHERE p_partkey % 8 = 7""")
def x05(i):
    return extract.comments(_lines(i))


@query("x01_imports", f"SELECT {_path} AS path, {_case({1: "'os.path'", 4: "'java.util.List'", 6: "'stdio.h'"})} AS name FROM part WHERE p_partkey % 8 IN (1, 4, 6)")
def x01(i):
    return extract.imports(_lines(i))


@query("x06_params", "SELECT p_partkey, ['a: ' || p_size, 'b'] AS parameters FROM part")
def x06(i):
    return i.table("part").select("p_partkey", extract.parameters(F.concat(F.lit("( a: "), F.col("p_size").cast("string"), F.lit(" , ,b )"))).alias("parameters"))


@query("x07_nested_params", "SELECT p_partkey, ['m: Map<K, ' || p_size || '>', 'f: fn(a, b)', 'c'] AS parameters FROM part")
def x07(i):
    return i.table("part").select("p_partkey", extract.nested_parameters(F.concat(F.lit("(m: Map<K, "), F.col("p_size").cast("string"), F.lit(">, f: fn(a, b), c)"))).alias("parameters"))


@query("x08_hints", f"""{FN} SELECT file_path, 'many functions: ' || count(*) AS hint FROM functions GROUP BY file_path HAVING count(*) > 50 UNION ALL SELECT file_path, 'many classes: ' || count(*) FROM classes GROUP BY file_path HAVING count(*) > 10
UNION ALL SELECT file_path, 'long function: ' || name FROM functions WHERE line_end - line_start > 100 UNION ALL SELECT file_path, 'many parameters: ' || name FROM functions WHERE n_params > 5""")
def x08(i):
    return extract.hints(i.bind("functions"), i.bind("classes"))


@query("x09_custom_rules", f"SELECT {_path} AS path, 'helper' AS name FROM part WHERE p_partkey % 8 = 1")
def x09(i):
    rules = extract.rules_with({"python": {"function": r"\b(helper)\(([^)]*)\)()"}})
    return extract.functions(_lines(i).where("language = 'python'"), rules).select("path", "name")


@query("x11_merge", f"{FN} SELECT 'functions' AS kind, file_path, count(*) AS n FROM functions GROUP BY file_path UNION ALL SELECT 'classes', file_path, count(*) FROM classes GROUP BY file_path")
def x11(i):
    bag = i.bind("functions").select(F.lit("functions").alias("kind"), "file_path").unionByName(i.bind("classes").select(F.lit("classes").alias("kind"), "file_path"))
    return bag.groupBy("kind", "file_path").agg(F.count("*").alias("n"))


@query("x12_languages", "SELECT source, list(DISTINCT lang ORDER BY lang) AS languages, count(DISTINCT lang) > 1 AS is_multi FROM documents GROUP BY source")
def x12(i):
    return extract.languages(i.table("documents"), "source", "lang")


@query("x13_file_summary", f"WITH {ctes('doc_lines')} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE contains(line, '|')) AS n_comments, count(*) FILTER (WHERE NOT contains(line, '|')) AS n_code, round(count(*) FILTER (WHERE contains(line, '|')) / count(*), 9) AS comment_ratio FROM doc_lines GROUP BY doc_id")
def x13(i):
    return extract.file_summary(i.bind("doc_lines"), F.col("line").contains("|"), "doc_id").withColumn("comment_ratio", F.round("comment_ratio", 9))


@query("x14_dir_agg", "SELECT source, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_lines, CAST(sum(n_chars % 50) AS BIGINT) AS n_comments, CAST(sum(doc_id % 20) AS BIGINT) AS complexity, CAST(floor(sum(doc_id % 20) / count(*)) AS BIGINT) AS avg_complexity, round(sum(n_chars % 50) / sum(n_chars), 9) AS comment_ratio FROM documents GROUP BY source")
def x14(i):
    d = i.table("documents").select("source", F.col("n_chars").alias("n_lines"), (F.col("n_chars") % 50).alias("n_comments"), (F.col("doc_id") % 20).alias("complexity"))
    return extract.folder_summary(d, "source").withColumn("comment_ratio", F.round("comment_ratio", 9))


@query("x15_preview", f"{FN}, l AS (SELECT file_path, list(name ORDER BY ord, name) AS names FROM functions GROUP BY file_path) SELECT file_path, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' and ' || (len(names) - 3) || ' more' ELSE '' END AS text FROM l")
def x15(i):
    return extract.preview(i.bind("functions"), "file_path")


#: A source file of each language with heads over several lines, nested brackets, methods, and comments that look like code; what they hold was checked by hand.
_samples = Path(__file__).parent / "samples"
_files = "a.ts b.py c.java d.cpp e.c f.go g.rs h.js".split()
_held = json.loads((_samples / "expected.json").read_text())
_at = "'src/' || p_partkey || '/' || f"


def _scanned(i, *kinds):
    """One of the files for each part: rows of these kinds."""
    content = F.get(F.array(*[F.lit((_samples / f"{f}.txt").read_text()) for f in _files]), F.col("k"))
    name = F.get(F.array(*[F.lit(f) for f in _files]), F.col("k"))
    # The numbers of a small table lie in one partition, and what is made of them is scanned by as many tasks.
    spread = i.table("part").select("p_partkey").repartition(int(i.spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    parts = spread.select("p_partkey", (F.col("p_partkey") % 8).cast("int").alias("k"))
    return scan.structure(parts.select(F.concat_ws("/", F.lit("src"), F.col("p_partkey").cast("string"), name).alias("path"), content.alias("content")), *kinds)


def _sql(v):
    if isinstance(v, list):
        return f"CAST([{', '.join(map(_sql, v))}] AS VARCHAR[])"
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _expected(kind, columns):
    """What a kind's rows are, for each part whose file it is."""
    rows = ", ".join(f"({_files.index(f)}, {_sql(f)}, {', '.join(map(_sql, r))})" for f, held in _held.items() for r in held[kind])
    return f"(VALUES {rows}) h(k, f, {columns}) JOIN part ON p_partkey % 8 = h.k"


@query("x01_parse", f"SELECT {_at} AS path, kind, count(*) AS n FROM (SELECT k, f, 'function' AS kind FROM (VALUES {', '.join(f'({_files.index(f)}, {_sql(f)})' for f, h in _held.items() for _ in h['function'])}) a(k, f) UNION ALL SELECT k, f, 'class' FROM (VALUES {', '.join(f'({_files.index(f)}, {_sql(f)})' for f, h in _held.items() for _ in h['class'])}) a(k, f)) h JOIN part ON p_partkey % 8 = h.k GROUP BY ALL")
def x01p(i):
    return _scanned(i, "function", "class").groupBy("path", "kind").agg(F.count("*").alias("n"))


@query("x02_code", f"SELECT {_at} AS path, name, parameters, return_type, visibility, is_async, line_start, line_end FROM {_expected('function', 'name, parameters, return_type, visibility, is_async, line_start, line_end')}")
def x02c(i):
    return scan.functions(_scanned(i, "function")).drop("language")


@query("x03_code", f"SELECT {_at} AS path, name, extends, implements, line_start, line_end FROM {_expected('class', 'name, extends, implements, line_start, line_end')}")
def x03c(i):
    return scan.classes(_scanned(i, "class")).drop("language")


@query("x04_code", f"SELECT {_at} AS path, callee, is_method, line FROM {_expected('call', 'callee, is_method, line')}")
def x04c(i):
    return scan.calls(_scanned(i, "call")).select("path", "callee", "is_method", "line")


@query("x05_code", f"SELECT {_at} AS path, text, is_doc, line FROM {_expected('comment', 'text, is_doc, line')}")
def x05c(i):
    return scan.comments(_scanned(i, "comment")).select("path", "text", "is_doc", "line")


@query("x10_rules", "SELECT * FROM (VALUES ('rust', 4), ('python', 4), ('javascript', 4), ('typescript', 4), ('java', 4), ('go', 4), ('c', 4), ('cpp', 4)) r(language, patterns)")
def x10(i):
    """Each of the eight languages has a pattern for heads, classes and blanked text, and rules for lines."""
    tables = (scan.HEADS, scan.CLASSES, scan.BLANK, extract.BUILT_IN)
    return i.spark.createDataFrame([(k, sum(k in t for t in tables)) for k in extract.BUILT_IN], "language string, patterns int")
