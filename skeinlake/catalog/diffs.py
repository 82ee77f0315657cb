"""S and D: sources, diffs, structural comparison."""

from pyspark.sql import functions as F

from ..functions.lookups import CHANGE_IMPACT, CHANGE_RISK, CONFIG_EXTENSIONS, LANGUAGES, WIDE_LANGUAGES, sql_case
from ..operators import diff
from ..sources import files, json
from .bindings import ctes
from .registry import query

P = f"WITH {ctes('paths')}, p AS (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM paths)"
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_pruned = f"len(list_intersect(string_split(path, '/')[:-2], {list(files.PRUNED)})) = 0"
_test = r"(regexp_matches(path, '(^|/)(tests?|__tests__|spec)/') OR regexp_matches(path, '(_test|\.test|\.spec|_spec)\.[^./]+$') OR regexp_matches(path, '(^|/)test_[^/]*$'))"
_code = f"ext IN {_in(files.CODE_EXTENSIONS)} AND {_pruned}"


@query("s01_code_files", f"{P} SELECT file_id, path FROM p WHERE {_code}")
def s01(i):
    return files.code_files(i.bind("paths")).select("file_id", "path")


@query("s02_without_tests", f"{P} SELECT file_id, path FROM p WHERE {_code} AND NOT {_test}")
def s02(i):
    return files.code_files(i.bind("paths"), skip_tests=True).select("file_id", "path")


@query("s03_of_language", f"{P} SELECT file_id, path FROM p WHERE ext IN ('ts', 'tsx') AND {_code}")
def s03(i):
    return files.code_files(i.bind("paths"), language="typescript").select("file_id", "path")


@query("s04_metric_files", f"{P} SELECT file_id, path FROM p WHERE ext IN {_in(files.METRIC_EXTENSIONS)} AND NOT regexp_matches(path, '(^|/)\\.')")
def s04(i):
    return files.metric_files(i.bind("paths")).select("file_id", "path")


@query("s05_languages", f"{P} SELECT {sql_case('ext', LANGUAGES)} AS language, count(*) AS n FROM p GROUP BY 1")
def s05(i):
    return i.bind("paths").groupBy(files.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query("s06_kinds", f"{P} SELECT {sql_case('ext', WIDE_LANGUAGES)} AS language, CASE WHEN {_test} THEN 'test' WHEN ext IN {_in(CONFIG_EXTENSIONS)} THEN 'config' WHEN ext IN {_in(files.CODE_EXTENSIONS)} THEN 'code' ELSE 'other' END AS kind, count(*) AS n FROM p GROUP BY ALL")
def s06(i):
    return i.bind("paths").groupBy(files.language_of(F.col("path"), wide=True).alias("language"), files.file_kind(F.col("path")).alias("kind")).agg(F.count("*").alias("n"))


@query("s07_diff_union", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'unpushed' WHEN 'F' THEN 'staged' ELSE 'unstaged' END AS section FROM orders WHERE o_orderstatus IN ('O', 'F', 'P')")
def s07(i):
    o = i.table("orders")
    return files.diff_union({t: o.where(F.col("o_orderstatus") == s).select("o_orderkey") for t, s in (("unpushed", "O"), ("staged", "F"), ("unstaged", "P"), ("untracked", "none"))})


@query("s08_fallback", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def s08(i):
    o = i.table("orders").select("o_orderkey", "o_orderstatus")
    return files.first_nonempty(o.where("o_orderstatus = 'none'"), o.where("o_orderstatus = 'O'"), o).select("o_orderkey")


@query("s09_untracked", f"{P} SELECT file_id FROM p WHERE n_bytes <= 1000000 AND ext NOT IN {_in(files.BINARY_EXTENSIONS)}")
def s09(i):
    return files.readable_untracked(i.bind("paths")).select("file_id")


@query("s10_antijoin", f"{P} SELECT file_id, path FROM p WHERE path NOT IN (SELECT path FROM p WHERE path LIKE 'build/%' OR file_id % 10 = 0)")
def s10(i):
    p = i.bind("paths")
    return files.not_ignored(p, p.where("path like 'build/%' or file_id % 10 = 0")).select("file_id", "path")


@query("s11_at_commit", "SELECT doc_id, n_chars FROM documents WHERE source = 'src1' AND lang = 'en'")
def s11(i):
    return files.at_commit(i.table("documents").select("doc_id", "n_chars", F.col("source").alias("commit"), F.col("lang").alias("path")), "src1", "en").select("doc_id", "n_chars")


@query("s12_changed_paths", "SELECT DISTINCT lang || '/' || source AS path FROM documents")
def s12(i):
    return files.changed_paths(i.table("documents").select(F.concat_ws("/", "lang", "source").alias("path")))


@query("s13_scanner_exit", "SELECT event_id, (event_id % 4 IN (0, 1)) OR (event_id % 4 = 2 AND event_type IN ('click', 'error')) AS ok FROM events")
def s13(i):
    said = F.when(F.col("event_type") == "click", "").when(F.col("event_type") == "error", "No rules here").otherwise("boom")
    return i.table("events").select("event_id", files.scanner_succeeded((F.col("event_id") % 4).cast("int"), said).alias("ok"))


@query(
    "s14_json",
    """SELECT event_id, CAST(0 AS INTEGER) AS place, 'r' || event_id % 5 AS rule, 'src/a.rs' AS path, CAST(event_id % 90 AS BIGINT) AS line, CASE event_id % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'INFO' ELSE 'WARNING' END AS severity, CASE WHEN event_id % 2 = 0 THEN 'm' ELSE '' END AS message, CAST(NULL AS VARCHAR) AS fix FROM events WHERE event_id % 11 <> 0
UNION ALL SELECT event_id, 1, 'unknown', '', 0, 'WARNING', '', NULL FROM events WHERE event_id % 7 = 0 AND event_id % 11 <> 0""",
)
def s14(i):
    k = "event_id"
    body = F.expr(
        f"""concat('scanning 12 files ', CASE WHEN {k} % 11 = 0 THEN 'no json' ELSE concat('{{"results":[{{"check_id":"r', {k} % 5, '","path":"src/a.rs","start":{{"line":', {k} % 90, '}}', CASE {k} % 3 WHEN 0 THEN ',"severity":"ERROR"' ELSE '' END,
        ',"extra":{{', CASE WHEN {k} % 2 = 0 THEN '"message":"m"' ELSE '"x":1' END, CASE {k} % 3 WHEN 1 THEN ',"severity":"INFO"' ELSE '' END, '}}}}', CASE WHEN {k} % 7 = 0 THEN ',{{}}' ELSE '' END, ']}}') END)"""
    )
    return json.scanner_findings(i.table("events").select("event_id", body.alias("body")))


@query("s15_rule_folders", f"WITH {ctes('doc_lines')} SELECT lang, bool_or(pos <= 5 AND contains(line, 'Licensed')) AS valid FROM doc_lines GROUP BY lang")
def s15(i):
    return files.rule_folders(i.bind("doc_lines"), "lang", "Licensed", 5)


_line = "'{\"day\":\"' || day || '\",\"n\":' || CAST(lines_of_code AS STRING) || ',\"avg\":' || CAST(cycles AS STRING) || CASE WHEN lines_of_code % 7 = 0 THEN '' ELSE '.5}' END"


@query("s16_jsonl", f"WITH {ctes('snapshots')} SELECT branch, day, lines_of_code AS n, cycles + CAST(0.5 AS DOUBLE) AS avg FROM snapshots WHERE lines_of_code % 7 <> 0")
def s16(i):
    return json.parse_snapshots(i.bind("snapshots").select("branch", F.expr(_line).alias("line")))


@query("s18_topk_per_group", f"WITH {ctes('findings')} SELECT target, finding_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, finding_id) AS place FROM findings) WHERE place <= 3")
def s18(i):
    return files.top_per_group(i.bind("findings"), "target", [F.desc("score"), F.asc("finding_id")], 3).select("target", "finding_id", "place")


@query(
    "s19_issues",
    """SELECT CAST(event_id AS VARCHAR) AS id, 't' || event_id AS title, CASE WHEN event_id % 2 = 0 THEN 'open' ELSE 'closed' END AS state, CASE WHEN event_id % 2 = 0 THEN ['a', 'b'] ELSE CAST([] AS VARCHAR[]) END AS labels, CASE WHEN event_id % 2 = 1 THEN make_timestamp(1700000000000000 + event_id * 1000000) END AS created FROM events WHERE event_id % 13 <> 0""",
)
def s19(i):
    k = F.col("event_id").cast("string")
    a = F.concat(F.lit('{"iid":'), k, F.lit(',"title":"t'), k, F.lit('","state":"open","labels":["a","b"]}'))
    b = F.concat(F.lit('{"code":'), k, F.lit(',"name":"t'), k, F.lit('","issueStatusName":"closed","createdAt":'), (F.lit(1700000000000) + F.col("event_id") * 1000).cast("string"), F.lit("}"))
    return json.issues(i.table("events").select(F.when(F.col("event_id") % 13 == 0, "{}").when(F.col("event_id") % 2 == 0, a).otherwise(b).alias("body")))


@query("s20_idlist", "SELECT p_partkey, ['#' || p_size, '#x' || p_partkey] AS ids FROM part")
def s20(i):
    return i.table("part").select("p_partkey", files.id_list(F.concat(F.col("p_size").cast("string"), F.lit(" , ,x"), F.col("p_partkey").cast("string"), F.lit(",#"), F.col("p_size").cast("string"))).alias("ids"))


@query("s22_model_content", "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN 'v' || event_id END AS content FROM events")
def s22(i):
    v = F.concat(F.lit('"v'), F.col("event_id").cast("string"), F.lit('"'))
    shape = lambda a, b: F.concat(F.lit(a), v, F.lit(b))
    k = F.col("event_id") % 5
    body = F.when(k == 0, shape('{"message":{"content":', "}}")).when(k == 1, shape('{"choices":[{"message":{"content":', "}}]}")).when(k == 2, shape('{"response":', "}")).when(k == 3, shape('{"content":', "}")).otherwise("{}")
    return i.table("events").select("event_id", json.model_content(body).alias("content"))


@query("k03_csv_projection", f"""WITH {ctes('snapshots')} SELECT branch, CAST(date_trunc('second', ts) AS VARCHAR) AS ts, commit_hash, CAST(lines_of_code AS VARCHAR) AS lines_of_code, printf('%.2f', debt) AS debt, printf('%.2f', CAST(cycles AS DOUBLE)) AS complexity, printf('%.2f', stability) AS stability, printf('%.2f', CAST(lines_of_code AS DOUBLE)) AS coupling FROM snapshots""")
def k03(i):
    return json.csv_columns(i.bind("snapshots").withColumns({"complexity": F.col("cycles"), "coupling": F.col("lines_of_code")}))


@query("k04_json", "SELECT '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS json FROM orders")
def k04(i):
    return json.as_json(i.table("orders"), "o_orderkey", "o_orderstatus")


L = f"WITH {ctes('diff_lines')}"
_carry = r"c AS (SELECT *, starts_with(line, 'diff --git') AS is_header, last_value(CASE WHEN starts_with(line, 'diff --git') THEN regexp_replace(string_split(line, ' ')[-1], '^b/', '') END IGNORE NULLS) OVER (PARTITION BY diff_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path FROM diff_lines)"
_add, _rem = "(starts_with(line, '+') AND NOT starts_with(line, '+++'))", "(starts_with(line, '-') AND NOT starts_with(line, '---'))"
_name = lambda *alts: "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(line, '{k}([^{s}]+)[{s}]', 1)), '')" for k, s in alts) + ")"
_fn, _st, _if = _name(("fn ", "("), ("function ", "("), ("def ", "(")), _name(("struct ", r"{<\s"), ("class ", r"{<:(\s")), _name(("trait ", r"{<\s"), ("interface ", r"{<\s"))
_events = f"""{_carry}, e AS (
SELECT diff_id, pos, path, 'function' AS kind, {_fn} AS name, 'added' AS change, false AS breaking FROM c WHERE {_add} UNION ALL SELECT diff_id, pos, path, 'struct', {_st}, 'added', false FROM c WHERE {_add}
UNION ALL SELECT diff_id, pos, path, 'interface', {_if}, 'added', true FROM c WHERE {_add} UNION ALL SELECT diff_id, pos, path, 'function', {_fn}, 'removed', true FROM c WHERE {_rem})"""


@query("d01_carryforward", f"{L}, {_carry} SELECT diff_id, pos, path FROM c")
def d01(i):
    return diff.carry_path(i.bind("diff_lines")).select("diff_id", "pos", "path")


@query("d02_events", f"{L}, {_events} SELECT * FROM e WHERE name IS NOT NULL")
def d02(i):
    return diff.change_events(i.bind("diff_lines"))


@query("d03_risk", f"{L}, {_events} SELECT diff_id, CASE WHEN bool_or(breaking) THEN 'High' WHEN bool_or(kind IN ('function', 'struct')) THEN 'Medium' ELSE 'Low' END AS risk, count(*) AS n_events, count(DISTINCT path) AS n_modules FROM e WHERE name IS NOT NULL GROUP BY diff_id")
def d03(i):
    return diff.diff_risk(diff.change_events(i.bind("diff_lines")))


@query("d04_names", f"{L} SELECT diff_id, pos, {_fn} AS f, {_st} AS s, {_if} AS t FROM diff_lines")
def d04(i):
    line = F.col("line")
    return i.bind("diff_lines").select("diff_id", "pos", diff.function_name(line).alias("f"), diff.struct_name(line).alias("s"), diff.interface_name(line).alias("t"))


@query("d05_bylang", f"""{L}, {_carry}, o AS (SELECT *, max(CASE WHEN is_header THEN pos END) OVER w AS opened, max(CASE WHEN trim(line) = '' THEN pos END) OVER w AS closed FROM c WINDOW w AS (PARTITION BY diff_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, {sql_case("lower(regexp_extract(path, '\\.([^./]+)$', 1))", LANGUAGES)} AS language FROM o WHERE NOT is_header AND opened IS NOT NULL AND (closed IS NULL OR closed < opened) AND ({_add} OR starts_with(line, ' ')))
SELECT diff_id, language, string_agg(substr(line, 2), chr(10) ORDER BY pos) AS code FROM k WHERE language IS NOT NULL GROUP BY ALL""")
def d05(i):
    return diff.code_by_language(i.bind("diff_lines"))


@query("d06_languages", f"{L} SELECT DISTINCT diff_id, l AS language FROM diff_lines JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in diff.LANGUAGE_HINTS.items())}) h(k, l) ON starts_with(line, 'diff --git') AND contains(line, k)")
def d06(i):
    return diff.diff_languages(i.bind("diff_lines"), faithful=True)


@query("d07_linecount", f"{L} SELECT diff_id, count(*) FILTER (WHERE {_add}) AS added, count(*) FILTER (WHERE {_rem}) AS removed, count(*) FILTER (WHERE {_add} OR {_rem}) AS changed FROM diff_lines GROUP BY diff_id")
def d07(i):
    return diff.line_counts(i.bind("diff_lines"))


@query("d08_first_language", f"{L} SELECT diff_id, {sql_case("lower(regexp_extract(min_by(line, pos), '\\.([^./]+)$', 1))", LANGUAGES)} AS language FROM diff_lines WHERE starts_with(line, 'diff --git') GROUP BY diff_id")
def d08(i):
    return diff.first_language(i.bind("diff_lines"))


SIG = f"WITH {ctes('signatures_before', 'signatures_after')}"
_sig = lambda t: f"{t}.name || '(' || array_to_string({t}.parameters, ', ') || ')' || coalesce(' -> ' || {t}.return_type, '')"
_r, _im = sql_case("change_type", CHANGE_RISK), sql_case("change_type", CHANGE_IMPACT)


@query("d09_fullouter", f"""{SIG}, a AS (SELECT * FROM signatures_before), b AS (SELECT * FROM signatures_after), x AS (
SELECT a.name, 'FunctionRemoved' AS change_type, {_sig('a')} AS before, NULL AS after FROM a ANTI JOIN b ON a.name = b.name UNION ALL SELECT b.name, 'FunctionAdded', NULL, {_sig('b')} FROM b ANTI JOIN a ON a.name = b.name
UNION ALL SELECT a.name, 'ParameterCountChanged', CAST(a.n_params AS VARCHAR), CAST(b.n_params AS VARCHAR) FROM a JOIN b USING (name) WHERE a.n_params IS DISTINCT FROM b.n_params
UNION ALL SELECT a.name, 'ReturnTypeChanged', a.return_type, b.return_type FROM a JOIN b USING (name) WHERE a.return_type IS DISTINCT FROM b.return_type
UNION ALL SELECT a.name, 'VisibilityChanged', a.visibility, b.visibility FROM a JOIN b USING (name) WHERE a.visibility IS DISTINCT FROM b.visibility
UNION ALL SELECT a.name, 'FunctionSignatureChanged', {_sig('a')}, {_sig('b')} FROM a JOIN b ON a.name = b.name WHERE a.n_params IS NOT DISTINCT FROM b.n_params AND a.parameters IS DISTINCT FROM b.parameters)
SELECT name, change_type, {_r} AS risk, {_im} AS impact, before, after FROM x""")
def d09(i):
    return diff.compare_functions(i.bind("signatures_before"), i.bind("signatures_after"))


def _sets(kind, level):
    return f"""{SIG}, x AS (SELECT name, '{kind}' AS change_type, name AS before, CAST(NULL AS VARCHAR) AS after, '{level}' AS level FROM signatures_before WHERE name NOT IN (SELECT name FROM signatures_after)
UNION ALL SELECT name, '{kind}', NULL, name, NULL FROM signatures_after WHERE name NOT IN (SELECT name FROM signatures_before)) SELECT name, change_type, {_r} AS risk, coalesce(level, {_im}) AS impact, before, after FROM x"""


@query("d10_class_diff", _sets("StructureChanged", "Project"))
def d10(i):
    return diff.compare_classes(i.bind("signatures_before"), i.bind("signatures_after"))


@query("d11_set_diff", _sets("ModuleStructureChanged", "Local"))
def d11(i):
    return diff.compare_imports(i.bind("signatures_before"), i.bind("signatures_after"))


@query("d12_signature", f"{SIG} SELECT {_sig('b')} AS signature FROM signatures_before b")
def d12(i):
    return i.bind("signatures_before").select(diff.signature(F.col("name"), F.col("parameters"), F.col("return_type")).alias("signature"))


@query("d13_paired", f"{SIG} SELECT a.name, a.return_type AS before, b.return_type AS after FROM signatures_before a JOIN signatures_after b USING (name) WHERE a.return_type IS DISTINCT FROM b.return_type")
def d13(i):
    return diff.paired(i.bind("signatures_before").withColumn("content", F.col("return_type")), i.bind("signatures_after").withColumn("content", F.col("return_type")), "name")


@query("d14_file_impact", f"{SIG} SELECT name, 'src/lib.rs' AS file_path FROM signatures_before WHERE name NOT IN (SELECT name FROM signatures_after)")
def d14(i):
    return diff.file_impact(diff.compare_functions(i.bind("signatures_before"), i.bind("signatures_after")), "src/lib.rs").where("change_type = 'FunctionRemoved'").select("name", "file_path")


@query("d15_breaking", f"{SIG} SELECT name, 'parameters changed' AS problem FROM signatures_before a JOIN signatures_after b USING (name) WHERE a.parameters IS DISTINCT FROM b.parameters UNION ALL SELECT name, 'removed' FROM signatures_before WHERE name NOT IN (SELECT name FROM signatures_after)")
def d15(i):
    return diff.breaking_changes(i.bind("signatures_before"), i.bind("signatures_after"))
