"""The dependency graph from tables of functions, classes, imports, exports and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def function_importance(visibility: Column, is_async: Column, n_params: Column) -> Column:
    """0.5, more if public, async and by parameters; 1 at most."""
    return F.least(F.lit(1.0), F.lit(0.5) + F.when(visibility == "public", 0.2).otherwise(0.0) + F.when(is_async, 0.1).otherwise(0.0) + 0.02 * F.coalesce(n_params, F.lit(0)))


def class_importance(is_abstract: Column, extends: Column, n_implements: Column, n_methods: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.5) + F.when(is_abstract, 0.15).otherwise(0.0) + F.when(extends.isNotNull(), 0.1).otherwise(0.0) + 0.05 * F.coalesce(n_implements, F.lit(0)) + 0.01 * F.coalesce(n_methods, F.lit(0)))


def function_id(path: Column, name: Column) -> Column:
    return F.concat(F.lit("func:"), path, F.lit("::"), name)


def display_name(imported: Column) -> Column:
    """The last part of an import."""
    return F.element_at(F.split(imported, "[./:]"), -1)


def keep_first(nodes: DataFrame, order: str = "ord", last: bool = False) -> DataFrame:
    """One node for each id: the first by order, or the last."""
    pick = F.desc(order) if last else F.asc(order)
    return nodes.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(pick))).where("_k = 1").drop("_k")


def vertices(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, node_type, name, file_path, importance, ord) of files, functions and classes, before nodes of one id are merged."""
    path = F.concat(F.lit("file:"), F.col("file_path"))
    file = functions.select("file_path").union(classes.select("file_path")).distinct().select(path.alias("id"), F.lit("File").alias("node_type"), F.col("file_path").alias("name"), "file_path", F.lit(0.5).alias("importance"), F.lit(-1).cast("long").alias("ord"))
    f = functions.select(function_id(F.col("file_path"), F.col("name")).alias("id"), F.lit("Function").alias("node_type"), "name", "file_path", function_importance(F.col("visibility"), F.col("is_async"), F.col("n_params")).alias("importance"), F.col("ord").cast("long").alias("ord"))
    c = classes.select(F.concat(F.lit("class:"), "file_path", F.lit("::"), "name").alias("id"), F.lit("Class").alias("node_type"), "name", "file_path", class_importance(F.col("is_abstract"), F.col("extends"), F.col("n_implements"), F.col("n_methods")).alias("importance"), F.col("ord").cast("long").alias("ord"))
    return file.unionByName(f).unionByName(c)


def enclosing(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(call_id, file_path, callee, line, caller): the first function in list order whose lines hold the call; calls outside any have no row. The path is an equality, so the range is tested within a file only."""
    f = functions.select(F.col("file_path").alias("_path"), F.col("name").alias("_name"), "ord", "line_start", "line_end")
    return calls.join(f, (F.col("file_path") == F.col("_path")) & F.col("line").between(F.col("line_start"), F.col("line_end"))).groupBy("call_id", "file_path", "callee", "line").agg(F.min_by("_name", "ord").alias("caller"))


def same_file_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls edges whose callee is a function of the same file, one for each call."""
    names = functions.select("file_path", F.col("name").alias("callee")).distinct()
    return enclosing(calls, functions).join(names, ["file_path", "callee"]).select(function_id(F.col("file_path"), F.col("caller")).alias("src"), function_id(F.col("file_path"), F.col("callee")).alias("dst"), "call_id")


def unique_names(functions: DataFrame) -> DataFrame:
    """(callee, callee_id) of names that a single function in all files has."""
    return functions.select("name", function_id(F.col("file_path"), F.col("name")).alias("id")).distinct().groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("n"), F.min("id").alias("callee_id")).where("n = 1").drop("n")


def resolved_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls edges by globally unique name; ambiguous names give none."""
    return enclosing(calls, functions).join(unique_names(functions), "callee").select(function_id(F.col("file_path"), F.col("caller")).alias("src"), F.col("callee_id").alias("dst"), "call_id")


def file_edges(functions: DataFrame, classes: DataFrame, imports: DataFrame, exports: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst, edge_type, weight) of each file's own graph. An exported name is the function of that name, or else the class."""
    path = F.concat(F.lit("file:"), F.col("file_path"))
    row = lambda df, src, dst, kind, weight: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), F.lit(weight).alias("weight"))
    class_id = F.concat(F.lit("class:"), "file_path", F.lit("::"), "name")
    out = row(functions, path, function_id(F.col("file_path"), F.col("name")), "Contains", 1.0).unionByName(row(classes, path, class_id, "Contains", 1.0))
    out = out.unionByName(row(imports, path, F.concat(F.lit("module:"), "name"), "Imports", 0.8))
    f = functions.select("file_path", "name", F.lit(True).alias("_f")).distinct()
    c = classes.select("file_path", "name", F.lit(True).alias("_c")).distinct()
    named = exports.join(f, ["file_path", "name"], "left").join(c, ["file_path", "name"], "left").where("_f or _c")
    out = out.unionByName(row(named, path, F.when(F.col("_f"), function_id(F.col("file_path"), F.col("name"))).otherwise(class_id), "Exports", 0.9))
    return out.unionByName(row(same_file_calls(calls, functions), F.col("src"), F.col("dst"), "Calls", 1.0))


def global_graph(functions: DataFrame, classes: DataFrame, calls: DataFrame, faithful: bool = False, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, call edges) over all files. A call that resolves in its file and by its unique name is one edge, two if faithful."""
    nodes = keep_first(vertices(functions, classes), last=last)
    a, b = same_file_calls(calls, functions), resolved_calls(calls, functions)
    edges = a.unionByName(b)
    return nodes, edges if faithful else edges.distinct()


def inheritance(classes: DataFrame) -> DataFrame:
    """(src, dst): a class and the one that it extends."""
    return classes.where("extends is not null").select(F.col("name").alias("src"), F.col("extends").alias("dst"))


def guard_size(files: DataFrame, most: int = 1500, confirmed: bool = False) -> int:
    """The number of files; more than the limit without confirmation raises."""
    n = files.count()
    if n > most and not confirmed:
        raise ValueError(f"{n} files are more than {most}; confirm to go on")
    return n
