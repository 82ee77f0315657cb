"""Source trees, diffs and listings as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lookups import CONFIG_EXTENSIONS, LANGUAGES, WIDE_LANGUAGES, case, extension

CODE_EXTENSIONS = tuple("c cc cpp cxx go h hpp hxx java js jsx py rs ts tsx".split())
PRUNED = tuple(".git .venv __pycache__ build dist node_modules target vendor".split())
METRIC_EXTENSIONS = tuple("c cpp go java js py rs ts".split())
BINARY_EXTENSIONS = tuple("bin dll exe gif gz ico jpeg jpg pdf png so tar zip".split())
MAX_UNTRACKED = 1_000_000


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, n_bytes, modified, content) of every file under a folder. Filters on path and size prune files before they are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select("path", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))


def under(path: Column, folders: Sequence[str]) -> Column:
    """Whether a component of the path, but the last, is one of these folders."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*[F.lit(f) for f in folders]))


def code_files(files: DataFrame, skip_tests: bool = False, language: str | None = None, pruned: Sequence[str] = PRUNED) -> DataFrame:
    """Files with a code extension outside the pruned folders; without tests, or of one language."""
    out = files.where(extension(F.col("path")).isin(*CODE_EXTENSIONS) & ~under(F.col("path"), pruned))
    if skip_tests:
        out = out.where(~is_test(F.col("path")))
    if language is not None:
        out = out.where(language_of(F.col("path")) == language)
    return out


def metric_files(files: DataFrame) -> DataFrame:
    """Files of the eight languages that metrics are taken of; any hidden component leaves a file out."""
    return files.where(extension(F.col("path")).isin(*METRIC_EXTENSIONS) & ~F.col("path").rlike(r"(^|/)\."))


def is_test(path: Column) -> Column:
    """Tests by folder or by file name."""
    return path.rlike(r"(^|/)(tests?|__tests__|spec)/") | path.rlike(r"(_test|\.test|\.spec|_spec)\.[^./]+$") | path.rlike(r"(^|/)test_[^/]*$")


def language_of(path: Column, wide: bool = False) -> Column:
    """Language by the lower-cased extension: the eight that are parsed, or the wider table."""
    return case(extension(path), WIDE_LANGUAGES if wide else LANGUAGES)


def file_kind(path: Column) -> Column:
    """test, config, code or other."""
    return F.when(is_test(path), "test").when(extension(path).isin(*CONFIG_EXTENSIONS), "config").when(extension(path).isin(*CODE_EXTENSIONS), "code").otherwise("other")


def diff_union(sections: dict[str, DataFrame]) -> DataFrame:
    """The lines of several diffs, each with the title of its section. Empty sections give nothing; all empty is an error of the caller's to raise."""
    out = None
    for title, df in sections.items():
        part = df.withColumn("section", F.lit(title))
        out = part if out is None else out.unionByName(part)
    return out


def first_nonempty(*candidates: DataFrame) -> DataFrame:
    """The first of these tables that has a row, the last if none has."""
    for df in candidates[:-1]:
        if not df.isEmpty():
            return df
    return candidates[-1]


def readable_untracked(files: DataFrame) -> DataFrame:
    """Untracked files of at most a million bytes without a binary extension."""
    return files.where((F.col("n_bytes") <= MAX_UNTRACKED) & ~extension(F.col("path")).isin(*BINARY_EXTENSIONS))


def not_ignored(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """Files whose path isn't in the ignored list."""
    return files.join(ignored.select("path"), "path", "left_anti")


def at_commit(blobs: DataFrame, commit: str, path: str | None = None) -> DataFrame:
    """Contents at a commit, of one path if given."""
    out = blobs.where(F.col("commit") == commit)
    return out if path is None else out.where(F.col("path") == path)


def changed_paths(changes: DataFrame) -> DataFrame:
    return changes.select("path").distinct()


def scanner_succeeded(code: Column, errors: Column) -> Column:
    """Exit codes of a scanner run: 0 and 1 are fine, 2 is if it says nothing or that there was nothing to do."""
    return (code.isin(0, 1)) | ((code == 2) & ((F.trim(errors) == "") | errors.contains("No rules") | errors.contains("No files")))


def rule_folders(lines: DataFrame, folder: str, marker: str = "rules:", within: int = 200) -> DataFrame:
    """(folder, valid): whether a file of the folder has the marker in its first lines."""
    return lines.groupBy(folder).agg(F.coalesce(F.bool_or((F.col("pos") <= within) & F.col("line").contains(marker)), F.lit(False)).alias("valid"))


def top_per_group(rows: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)


def id_list(text: Column) -> Column:
    """Ids of a comma-separated list: trimmed, without empty ones, with a leading #, each once in the order of the first."""
    parts = F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.array_distinct(F.transform(parts, lambda s: F.when(s.startswith("#"), s).otherwise(F.concat(F.lit("#"), s))))
