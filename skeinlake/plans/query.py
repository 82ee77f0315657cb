"""A generic query over a table: filters, sorts, a page. Compiled to columns, so that no text needs escaping."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "contains": lambda c, v: c.contains(v), "gt": lambda c, v: c > v, "lt": lambda c, v: c < v, "ge": lambda c, v: c >= v,
    "le": lambda c, v: c <= v, "in": lambda c, v: c.isin(*v), "not_in": lambda c, v: ~c.isin(*v), "is_null": lambda c, v: c.isNull(), "is_not_null": lambda c, v: c.isNotNull(),
}


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: object = None

    def column_expression(self) -> Column:
        return OPERATORS[self.operator](F.col(self.column), self.value)


@dataclass(frozen=True)
class Page:
    number: int = 1
    size: int = 20

    def __post_init__(self):
        if self.number < 1 or not 1 <= self.size <= 1000:
            raise ValueError("a page's number is 1 or more, its size 1 to 1000")

    @property
    def offset(self) -> int:
        return (self.number - 1) * self.size

    def total_pages(self, rows: int) -> int:
        return -(-rows // self.size)

    def has_next(self, rows: int) -> bool:
        return self.number < self.total_pages(rows)


@dataclass(frozen=True)
class Criteria:
    """What rows, in what order, which page. Sorting by keys that tie leaves the page open: callers add a unique key."""

    filters: Sequence[Filter] = ()
    sorts: Sequence[tuple[str, bool]] = ()
    page: Page | None = None
    extra: Sequence[Column] = field(default_factory=tuple)

    def predicate(self) -> Column | None:
        parts = [f.column_expression() for f in self.filters] + list(self.extra)
        return reduce(lambda a, b: a & b, parts) if parts else None

    def apply(self, df: DataFrame) -> DataFrame:
        predicate = self.predicate()
        out = df if predicate is None else df.where(predicate)
        if self.sorts:
            out = out.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in self.sorts])
        return out if self.page is None else out.offset(self.page.offset).limit(self.page.size)


def all_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def none_of(*parts: Column) -> Column:
    return ~any_of(*parts)


def contains_point(start: Column, end: Column, point: Column) -> Column:
    return point.between(start, end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals with a point in common."""
    return (a_start <= b_end) & (b_start <= a_end)


def overlapping_pairs(df: DataFrame, key: str, ident: str) -> DataFrame:
    """Pairs of intervals of one key that overlap. The key is an equality, so ranges are compared within it only."""
    a = df.select(key, F.col(ident).alias("left_id"), F.col("line_start").alias("_s"), F.col("line_end").alias("_e"))
    b = df.select(F.col(key).alias("_key"), F.col(ident).alias("right_id"), "line_start", "line_end")
    return a.join(b, (F.col(key) == F.col("_key")) & (F.col("left_id") < F.col("right_id")) & overlaps(F.col("_s"), F.col("_e"), F.col("line_start"), F.col("line_end"))).select(key, "left_id", "right_id")


def coalesced(df: DataFrame, key: str) -> DataFrame:
    """(key, start, end, n): the fewest closed intervals that cover those of each key."""
    w = Window.partitionBy(key).orderBy("line_start", "line_end")
    before = F.max("line_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(before.isNull() | (F.col("line_start") > before), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(key, "_island").agg(F.min("line_start").alias("start"), F.max("line_end").alias("end"), F.count("*").alias("n")).drop("_island")


def add_tag(tags: Column, tag: str) -> Column:
    return F.array_union(tags, F.array(F.lit(tag)))


def remove_tag(tags: Column, tag: str) -> Column:
    return F.array_remove(tags, tag)


def has_tag(tags: Column, tag: str) -> Column:
    return F.array_contains(tags, tag)


def history(commits: DataFrame, author: str | None = None, since=None, until=None, grep: str | None = None, skip: int = 0, most: int | None = None) -> DataFrame:
    """Commits (id, author, ts, message), the newest first: filtered, then skipped and cut."""
    out = commits
    if author is not None:
        out = out.where(F.col("author") == author)
    if since is not None:
        out = out.where(F.col("ts") >= since)
    if until is not None:
        out = out.where(F.col("ts") <= until)
    if grep is not None:
        out = out.where(F.col("message").rlike(grep))
    out = out.orderBy(F.desc("ts"), F.desc("id")).offset(skip)
    return out if most is None else out.limit(most)
