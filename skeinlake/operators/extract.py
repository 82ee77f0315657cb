"""Structure from source text: functions, classes, calls and comments by a table of rules for each language.

A line of code is matched by regular expressions in the JVM; no parser and no Python worker is involved. scan.py reads whole
files and knows more forms; this is for rules of one's own and for text that comes as lines. The documented subset: one declaration a line, its parameters on the same line; a body ends where braces balance again, or for Python where the
indentation returns. Strings and comments that look like declarations count as such.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookups import LANGUAGES, case, extension


@dataclass(frozen=True)
class Rules:
    """Regular expressions of a language. function: name, parameters, return type; klass: name, base, interfaces; doc: prefixes of documentation comments."""

    function: str
    klass: str
    comment: str
    doc: tuple[str, ...]
    public: str = r"\bpub\b|\bpublic\b|\bexport\b"
    is_async: str = r"\basync\b"
    imports: str = r"^\s*(?:import|use)\s+([\w.:{}*/]+)"


_C = r"^\s*(?:[\w:<>*&]+\s+)+\*?(\w+)\s*\(([^)]*)\)()\s*\{"
BUILT_IN: dict[str, Rules] = {
    "rust": Rules(r"\bfn\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)(?:\s*->\s*([^{;]+))?", r"\b(?:struct|enum|trait)\s+(\w+)()()", r"^\s*//.*$", ("///", "//!")),
    "python": Rules(r"\bdef\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*([^:]+))?", r"^\s*class\s+(\w+)(?:\(\s*(\w+)?([^)]*)\))?", r"^\s*#.*$", ('"""', "'''"), public=r"\bdef\s+[^_]", imports=r"^\s*(?:from|import)\s+([\w.]+)"),
    "javascript": Rules(r"\bfunction\s*\*?\s*(\w+)\s*\(([^)]*)\)()", r"\bclass\s+(\w+)(?:\s+extends\s+(\w+))?()", r"^\s*//.*$", ("/**",), imports=r"^\s*import\s.*['\"]([^'\"]+)['\"]"),
    "typescript": Rules(r"\bfunction\s*\*?\s*(\w+)\s*(?:<[^>]*>)?\(([^)]*)\)(?:\s*:\s*([^{]+))?", r"\b(?:class|interface)\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w, ]+))?", r"^\s*//.*$", ("/**",), imports=r"^\s*import\s.*['\"]([^'\"]+)['\"]"),
    "java": Rules(r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?!return\b|new\b|else\b)[\w<>\[\]]+\s+(\w+)\s*\(([^)]*)\)()\s*(?:throws\s+[\w, ]+)?\{", r"\b(?:class|interface)\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w, ]+))?", r"^\s*//.*$", ("/**",), imports=r"^\s*import\s+(?:static\s+)?([\w.*]+)"),
    "go": Rules(r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)\s*\(([^)]*)\)\s*([^{]*)", r"\btype\s+(\w+)\s+(?:struct|interface)()()", r"^\s*//.*$", ("// ",), public=r"\bfunc\s+(?:\([^)]*\)\s*)?[A-Z]", imports=r"^\s*(?:import\s+)?\"([^\"]+)\""),
    "c": Rules(_C, r"\bstruct\s+(\w+)()()\s*\{", r"^\s*//.*$", ("/**",), imports=r"^\s*#include\s+[<\"]([^>\"]+)[>\"]"),
    "cpp": Rules(_C, r"\b(?:class|struct)\s+(\w+)(?:\s*:\s*public\s+(\w+))?()\s*\{", r"^\s*//.*$", ("///", "/**"), imports=r"^\s*#include\s+[<\"]([^>\"]+)[>\"]"),
}


def rules_with(custom: dict[str, dict]) -> dict[str, Rules]:
    """The built-in rules, with single fields of languages replaced; a new language must give all it needs."""
    out = dict(BUILT_IN)
    for language, fields in custom.items():
        out[language] = replace(out[language], **fields) if language in out else Rules(**fields)
    return out


def code_lines(files: DataFrame) -> DataFrame:
    """(path, language, pos, line) of files (path, content); unknown languages are left out."""
    known = files.select("path", case(extension(F.col("path")), LANGUAGES).alias("language"), "content").where("language is not null")
    return known.select("path", "language", F.posexplode(F.split("content", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


def _by_language(rules: dict[str, Rules], make) -> Column:
    out = None
    for language, r in rules.items():
        value = make(r)
        out = F.when(F.col("language") == language, value) if out is None else out.when(F.col("language") == language, value)
    return out


def parameters(text: Column) -> Column:
    """A parameter list without its parentheses' spaces, split at commas; empty ones are dropped."""
    inner = F.regexp_replace(F.trim(text), r"^\(|\)$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda s: F.trim(s)), lambda p: p != "")


def nested_parameters(text: Column) -> Column:
    """Splits at commas outside brackets of any kind, by a running depth over the characters."""
    chars = F.split(F.regexp_replace(F.trim(text), r"^\(|\)$", ""), "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("depth"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c.isin("(", "<", "[", "{"), 1).when(c.isin(")", ">", "]", "}"), -1).otherwise(0)
        cut = (c == ",") & (a["depth"] == 0)
        return F.struct(F.when(cut, F.concat(a["done"], F.array(F.trim(a["now"])))).otherwise(a["done"]).alias("done"), F.when(cut, F.lit("")).otherwise(F.concat(a["now"], c)).alias("now"), depth.cast("int").alias("depth"))

    whole = F.aggregate(chars, start, step, lambda a: F.concat(a["done"], F.array(F.trim(a["now"]))))
    return F.filter(whole, lambda p: p != "")


def _ends(lines: DataFrame) -> DataFrame:
    """Lines with the running depth of braces after them, and the indentation."""
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda s: F.length("line") - F.length(F.replace("line", F.lit(s), F.lit("")))
    return lines.withColumn("after", F.sum(count("{") - count("}")).over(w)).withColumn("indent", F.length("line") - F.length(F.ltrim("line"))).withColumn("solid", F.trim("line") != "")


def _bodies(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds line_end: the first line from the start on at which braces are as deep as before it, or the last that is indented deeper. A file's lines come to its functions as one array, so nothing is multiplied."""
    rows = _ends(lines).groupBy(F.col("path").alias("_p")).agg(F.collect_list(F.struct("pos", "after", "indent", "solid")).alias("_lines"))
    python, start = F.col("language") == "python", F.col("line_start")
    deep = lambda x: F.when(python, x["solid"] & (x["pos"] > start) & (x["indent"] <= F.col("indent"))).otherwise((x["pos"] >= start) & (x["after"] <= F.col("before")) & ((x["pos"] > start) | F.col("closed")))
    stop = F.array_min(F.transform(F.filter("_lines", deep), lambda x: F.when(python, x["pos"] - 1).otherwise(x["pos"])))
    end = F.coalesce(stop, F.array_max(F.transform("_lines", lambda x: x["pos"])))
    return found.join(rows, F.col("path") == F.col("_p"), "left").select(*[c for c in found.columns if c not in ("before", "indent", "closed")], end.alias("line_end"))


def functions(lines: DataFrame, rules: dict[str, Rules] = BUILT_IN) -> DataFrame:
    """(path, language, name, parameters, return_type, visibility, is_async, line_start, line_end): functions and methods, each once."""
    part = lambda k: _by_language(rules, lambda r: F.regexp_extract("line", r.function, k))
    flag = lambda name: _by_language(rules, lambda r: F.col("line").rlike(getattr(r, name)))
    count = lambda s: F.length("line") - F.length(F.replace("line", F.lit(s), F.lit("")))
    found = _ends(lines).select(
        "path", "language", part(1).alias("name"), parameters(part(2)).alias("parameters"), F.nullif(F.trim(part(3)), F.lit("")).alias("return_type"), F.when(flag("public"), "public").otherwise("private").alias("visibility"), flag("is_async").alias("is_async"),
        F.col("pos").alias("line_start"), (F.col("after") - count("{") + count("}")).alias("before"), "indent", (F.col("line").contains("}") | F.trim("line").endswith(";")).alias("closed"),
    ).where("name <> ''")
    return _bodies(found, lines)


def classes(lines: DataFrame, rules: dict[str, Rules] = BUILT_IN) -> DataFrame:
    """(path, language, name, extends, implements, line_start)."""
    part = lambda k: _by_language(rules, lambda r: F.regexp_extract("line", r.klass, k))
    return lines.select("path", "language", part(1).alias("name"), F.nullif(part(2), F.lit("")).alias("extends"), parameters(part(3)).alias("implements"), F.col("pos").alias("line_start")).where("name <> ''")


def calls(lines: DataFrame, rules: dict[str, Rules] = BUILT_IN) -> DataFrame:
    """(path, callee, line, is_method): names before a parenthesis, but for keywords and the names that a line declares."""
    keywords = ["if", "for", "while", "match", "switch", "return", "catch", "fn", "def", "function", "func", "sizeof", "elif", "and", "or", "not", "in"]
    declared = _by_language(rules, lambda r: F.regexp_extract("line", r.function, 1))
    comment = _by_language(rules, lambda r: F.col("line").rlike(r.comment))
    found = lines.where(~comment).select("path", F.col("pos").alias("line"), declared.alias("declared"), F.explode(F.regexp_extract_all("line", F.lit(r"((?:\w+(?:\.|::))*\w+)\s*\("), F.lit(1))).alias("text"))
    name = F.element_at(F.split("text", r"\.|::"), -1)
    return found.withColumn("callee", name).where(~F.col("callee").isin(*keywords) & ~F.col("callee").rlike("^[0-9]") & (F.col("callee") != F.col("declared"))).select("path", "callee", "line", (F.col("text").contains(".") | F.col("text").contains("::")).alias("is_method"))


def comments(lines: DataFrame, rules: dict[str, Rules] = BUILT_IN) -> DataFrame:
    """(path, text, line, is_doc): line comments, and the lines that open documentation."""
    is_doc = _by_language(rules, lambda r: reduce(or_, [F.trim("line").startswith(p) for p in r.doc]))
    comment = _by_language(rules, lambda r: F.col("line").rlike(r.comment))
    return lines.where(comment | is_doc).select("path", F.trim("line").alias("text"), F.col("pos").alias("line"), is_doc.alias("is_doc"))


def imports(lines: DataFrame, rules: dict[str, Rules] = BUILT_IN) -> DataFrame:
    """(path, name) of imported modules."""
    return lines.select("path", _by_language(rules, lambda r: F.regexp_extract("line", r.imports, 1)).alias("name")).where("name <> ''").distinct()


def hints(functions: DataFrame, classes: DataFrame, path: str = "file_path") -> DataFrame:
    """(path, hint): over 50 functions, over 10 classes, functions of over 100 lines or 5 parameters."""
    many = functions.groupBy(path).agg(F.count("*").alias("n")).where("n > 50").select(path, F.concat(F.lit("many functions: "), F.col("n").cast("string")).alias("hint"))
    wide = classes.groupBy(path).agg(F.count("*").alias("n")).where("n > 10").select(path, F.concat(F.lit("many classes: "), F.col("n").cast("string")).alias("hint"))
    long = functions.where("line_end - line_start > 100").select(path, F.concat(F.lit("long function: "), "name").alias("hint"))
    params = functions.where("n_params > 5").select(path, F.concat(F.lit("many parameters: "), "name").alias("hint"))
    return many.unionByName(wide).unionByName(long).unionByName(params)


def file_summary(lines: DataFrame, comment: Column, key: str) -> DataFrame:
    """(key, n_lines, n_comments, n_code, comment_ratio) with the real number of lines."""
    return lines.groupBy(key).agg(F.count("*").alias("n_lines"), F.count_if(comment).alias("n_comments")).withColumn("n_code", F.col("n_lines") - F.col("n_comments")).withColumn("comment_ratio", F.try_divide("n_comments", "n_lines"))


def folder_summary(files: DataFrame, by: str) -> DataFrame:
    """Sums over the files of a folder or language, and the whole-number mean complexity."""
    return files.groupBy(by).agg(F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"), F.sum("n_comments").alias("n_comments"), F.sum("complexity").alias("complexity")).withColumn("avg_complexity", F.floor(F.col("complexity") / F.col("n_files"))).withColumn("comment_ratio", F.try_divide("n_comments", "n_lines"))


def languages(files: DataFrame, by: str, language: str) -> DataFrame:
    """(by, languages, is_multi)."""
    return files.groupBy(by).agg(F.array_sort(F.collect_set(language)).alias("languages")).withColumn("is_multi", F.size("languages") > 1)


def preview(functions: DataFrame, by: str, k: int = 3) -> DataFrame:
    """(by, text): the first few names and how many more."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"])
    more = F.when(F.size("names") > k, F.concat(F.lit(" and "), (F.size("names") - k).cast("string"), F.lit(" more"))).otherwise("")
    return functions.groupBy(by).agg(names.alias("names")).select(by, F.concat(F.array_join(F.slice("names", 1, k), ", "), more).alias("text"))
