"""Diff text to events, and comparison of two states of a code base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookups import CHANGE_IMPACT, CHANGE_RISK, LANGUAGES, case, extension

LANGUAGE_HINTS = {".rs": "rust", ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".c": "c", ".cpp": "cpp"}


def carry_path(lines: DataFrame, key: str = "diff_id") -> DataFrame:
    """Each line with the path of the last header at or before it (null before the first). A diff is ordered in one task; diffs go to different ones."""
    header = F.col("line").startswith("diff --git")
    path = F.regexp_replace(F.element_at(F.split("line", " "), -1), "^b/", "")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("path", F.last(F.when(header, path), ignorenulls=True).over(w)).withColumn("is_header", header)


def _between(line: Column, keyword: str, stops: str) -> Column:
    """The text from after a keyword up to the first stop; null without either."""
    return F.nullif(F.trim(F.regexp_extract(line, rf"{keyword}([^{stops}]+)[{stops}]", 1)), F.lit(""))


def function_name(line: Column) -> Column:
    """A name after fn, function or def, up to the parenthesis."""
    return F.coalesce(_between(line, "fn ", "("), _between(line, "function ", "("), _between(line, "def ", "("))


def struct_name(line: Column) -> Column:
    return F.coalesce(_between(line, "struct ", r"{<\s"), _between(line, "class ", r"{<:(\s"))


def interface_name(line: Column) -> Column:
    return F.coalesce(_between(line, "trait ", r"{<\s"), _between(line, "interface ", r"{<\s"))


def change_events(lines: DataFrame, key: str = "diff_id") -> DataFrame:
    """(key, pos, path, kind, name, change, breaking): functions, structs and interfaces that a diff adds, and functions it removes."""
    d = carry_path(lines, key).where("not is_header")
    line = F.col("line")
    added, removed = line.startswith("+") & ~line.startswith("+++"), line.startswith("-") & ~line.startswith("---")
    event = lambda name, kind, change, breaking: F.when(name.isNotNull(), F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit(change).alias("change"), F.lit(breaking).alias("breaking")))
    found = F.array_compact(
        F.array(
            F.when(added, event(function_name(line), "function", "added", False)), F.when(added, event(struct_name(line), "struct", "added", False)),
            F.when(added, event(interface_name(line), "interface", "added", True)), F.when(removed, event(function_name(line), "function", "removed", True)),
        )
    )
    return d.select(key, "pos", "path", F.explode(found).alias("e")).select(key, "pos", "path", "e.*")


def diff_risk(events: DataFrame, key: str = "diff_id") -> DataFrame:
    """High with any breaking event, Medium with any function or struct event, else Low."""
    return events.groupBy(key).agg(F.when(F.bool_or("breaking"), "High").when(F.bool_or(F.col("kind").isin("function", "struct")), "Medium").otherwise("Low").alias("risk"), F.count("*").alias("n_events"), F.countDistinct("path").alias("n_modules"))


def code_by_language(lines: DataFrame, key: str = "diff_id") -> DataFrame:
    """(key, language, code): added and context lines of each language, joined in order; a blank line closes a file's section."""
    d = carry_path(lines, key)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("opened", F.max(F.when(F.col("is_header"), F.col("pos"))).over(w)).withColumn("closed", F.max(F.when(F.trim("line") == "", F.col("pos"))).over(w))
    kept = d.where("not is_header and opened is not null and (closed is null or closed < opened)").where((F.col("line").startswith("+") & ~F.col("line").startswith("+++")) | F.col("line").startswith(" "))
    kept = kept.withColumn("language", case(extension(F.col("path")), LANGUAGES)).where("language is not null")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.expr("substring(line, 2)").alias("text"))))
    return kept.groupBy(key, "language").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("code"))


def diff_languages(lines: DataFrame, key: str = "diff_id", faithful: bool = False) -> DataFrame:
    """Distinct languages of a diff's files, by extension; faithful: by a piece of the header line, so that .json counts as JavaScript."""
    headers = lines.where(F.col("line").startswith("diff --git"))
    if faithful:
        found = F.array_compact(F.array(*[F.when(F.col("line").contains(k), v) for k, v in LANGUAGE_HINTS.items()]))
        return headers.select(key, F.explode(found).alias("language")).distinct()
    return headers.select(key, case(extension(F.element_at(F.split("line", " "), -1)), LANGUAGES).alias("language")).where("language is not null").distinct()


def line_counts(lines: DataFrame, key: str = "diff_id") -> DataFrame:
    """Added and removed lines of each diff."""
    line = F.col("line")
    return lines.groupBy(key).agg(F.count_if(line.startswith("+") & ~line.startswith("+++")).alias("added"), F.count_if(line.startswith("-") & ~line.startswith("---")).alias("removed")).withColumn("changed", F.col("added") + F.col("removed"))


def first_language(lines: DataFrame, key: str = "diff_id") -> DataFrame:
    """The language of the first header, null if unknown."""
    d = lines.where(F.col("line").startswith("diff --git"))
    return d.groupBy(key).agg(F.min_by("line", "pos").alias("h")).select(key, case(extension(F.element_at(F.split("h", " "), -1)), LANGUAGES).alias("language"))


def _changes(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({"risk": case(F.col("change_type"), CHANGE_RISK), "impact": F.coalesce("level", case(F.col("change_type"), CHANGE_IMPACT))}).select(*columns, "change_type", "risk", "impact", "before", "after")


def signature(name: Column, parameters: Column, return_type: Column) -> Column:
    """fn name(a, b) -> r"""
    return F.concat(name, F.lit("("), F.array_join(parameters, ", "), F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), return_type), F.lit("")))


def compare_functions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change_type, risk, impact, before, after): one full outer join on name; matches give up to four changes."""
    a, b = before.alias("a"), after.alias("b")
    j = a.join(b, F.col("a.name") == F.col("b.name"), "full_outer")
    sig = lambda t: F.when(F.col(f"{t}.name").isNotNull(), signature(F.col(f"{t}.name"), F.col(f"{t}.parameters"), F.col(f"{t}.return_type")))
    both = F.col("a.name").isNotNull() & F.col("b.name").isNotNull()
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    e = lambda cond, kind, x, y: F.when(cond, F.struct(F.lit(kind).alias("change_type"), x.alias("before"), y.alias("after")))
    text = lambda c: c.cast("string")
    found = F.array_compact(
        F.array(
            e(F.col("b.name").isNull(), "FunctionRemoved", sig("a"), F.lit(None).cast("string")), e(F.col("a.name").isNull(), "FunctionAdded", F.lit(None).cast("string"), sig("b")),
            e(both & ~same("n_params"), "ParameterCountChanged", text(F.col("a.n_params")), text(F.col("b.n_params"))), e(both & ~same("return_type"), "ReturnTypeChanged", F.col("a.return_type"), F.col("b.return_type")),
            e(both & ~same("visibility"), "VisibilityChanged", F.col("a.visibility"), F.col("b.visibility")), e(both & same("n_params") & ~same("parameters"), "FunctionSignatureChanged", sig("a"), sig("b")),
        )
    )
    rows = j.select(F.coalesce("a.name", "b.name").alias("name"), F.explode(found).alias("c")).select("name", "c.*", F.lit(None).cast("string").alias("level"))
    return _changes(rows, "name")


def compare_names(before: DataFrame, after: DataFrame, removed: str, added: str, removed_level: str | None = None) -> DataFrame:
    """Differences of two sets of names both ways."""
    gone = before.select("name").distinct().join(after.select("name"), "name", "left_anti").select("name", F.lit(removed).alias("change_type"), F.col("name").alias("before"), F.lit(None).cast("string").alias("after"), F.lit(removed_level).cast("string").alias("level"))
    new = after.select("name").distinct().join(before.select("name"), "name", "left_anti").select("name", F.lit(added).alias("change_type"), F.lit(None).cast("string").alias("before"), F.col("name").alias("after"), F.lit(None).cast("string").alias("level"))
    return _changes(gone.unionByName(new), "name")


def compare_classes(before: DataFrame, after: DataFrame) -> DataFrame:
    return compare_names(before, after, "StructureChanged", "StructureChanged", "Project")


def compare_imports(before: DataFrame, after: DataFrame) -> DataFrame:
    return compare_names(before, after, "ModuleStructureChanged", "ModuleStructureChanged", "Local")


def paired(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """States of files that both sides have, of those whose content differs."""
    b = after.select(key, F.col("content").alias("after"))
    return before.select(key, F.col("content").alias("before")).join(b, key).where("not (before <=> after)")


def file_impact(changes: DataFrame, path: str) -> DataFrame:
    """Changes of one file, stamped with its path."""
    return changes.withColumn("file_path", F.lit(path))


def breaking_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, problem): functions whose parameters differ, and those that are gone."""
    a = after.select("name", F.col("parameters").alias("_after"))
    changed = before.join(a, "name").where("not (parameters <=> _after)").select("name", F.lit("parameters changed").alias("problem"))
    return changed.unionByName(before.join(after.select("name"), "name", "left_anti").select("name", F.lit("removed").alias("problem")))
