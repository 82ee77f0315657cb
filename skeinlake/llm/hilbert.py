"""Sharding along a Hilbert curve: metadata dimensions are quantised, rows ordered by curve index, and the order cut into runs.

Rows near each other on the curve are near in every dimension, so each shard spans a small box and a filter on any dimension
skips most shards by their minima and maxima. The index is an expression over lookup tables, one step a bit, computed in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

#: Bits of each dimension; the curve has 2^(BITS * dimensions) cells.
BITS = 6
#: Characters of text a shard holds at most, but for one of a single longer document.
SHARD_CHARS = 128_000_000
#: Rows of a cell that one task orders at most, if doc_ids are dense: ids are taken in blocks of this many.
BLOCK = 1 << 20
DIMENSIONS = ("lang", "source", "n_chars")


@cache
def tables(n: int) -> tuple[list[int], list[int]]:
    """(digits, next states), at state * 2^n + corner, of the n-dimensional Hilbert curve.

    A state is an entry corner and a direction; corners are walked in Gray code order after the state's rotation.
    """
    size, full = 1 << n, (1 << n) - 1
    gray = lambda i: i ^ (i >> 1)
    rotate_left = lambda x, k: ((x << (k % n)) | (x >> (n - k % n))) & full
    rotate_right = lambda x, k: rotate_left(x, n - k % n)
    trailing = lambda i: (~i & (i + 1)).bit_length() - 1
    rank_of = {gray(i): i for i in range(size)}
    entry = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    direction = lambda i: 0 if i == 0 else trailing(i - 1) % n if i % 2 == 0 else trailing(i) % n
    states, digits, following = {(0, 0): 0}, [], []
    queue = [(0, 0)]
    for e, d in queue:
        for corner in range(size):
            w = rank_of[rotate_right(corner ^ e, d + 1)]
            to = (e ^ rotate_left(entry(w), d + 1), (d + direction(w) + 1) % n)
            if to not in states:
                states[to] = len(states)
                queue.append(to)
            digits.append(w)
            following.append(states[to])
    return digits, following


def curve_index(dims: Sequence[Column], bits: int = BITS) -> Column:
    """The place on the curve of a cell, given each dimension's level as an integer below 2^bits."""
    n = len(dims)
    digits, following = tables(n)
    look = lambda table, at: F.get(F.array(*[F.lit(x) for x in table]), at)
    state, index = F.lit(0), F.lit(0).cast("long")
    for b in reversed(range(bits)):
        corner = F.lit(0)
        for k, d in enumerate(dims):
            corner = corner + F.shiftleft(F.shiftright(d, b).bitwiseAND(F.lit(1)), k)
        at = state * (1 << n) + corner
        index = index * (1 << n) + look(digits, at)
        state = look(following, at)
    return index


def magnitude(value: Column) -> Column:
    """Two levels for each power of two of a non-negative integer, in 0 .. 63; null and negative count as 0."""
    v = F.greatest(F.coalesce(value.cast("long"), F.lit(0)), F.lit(0))
    width = F.length(F.bin(v))
    return F.least(F.when(v < 2, v).otherwise(2 * (width - 1) + F.call_function("shiftrightunsigned", v, width - 2).bitwiseAND(F.lit(1))), F.lit(63)).cast("int")


def hilbert_shards(docs: DataFrame, bits: int = BITS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, curve, shard) for each row of docs: its place on the curve through (lang, source, n_chars) and its shard.

    lang and source are quantised by their rank among the distinct values (nulls first), n_chars by magnitude. Rows are
    ordered by curve index, then doc_id (nulls first), then n_chars; the shard is the number of characters before a row in
    that order by shard_chars. A null or negative n_chars counts as no characters. Repeated rows share a place, and what
    stands before them, so they share a shard. No text is read, and prefix sums go over cells, blocks of ids and rows in
    turn, so none of them is taken over all rows in one task.
    """
    return _placed(docs, bits, shard_chars).select("doc_id", "curve", "shard")


def _placed(docs: DataFrame, bits: int, shard_chars: int) -> DataFrame:
    """(doc_id, lang, source, n_chars, curve, shard) for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    side = 1 << bits
    for name in ("lang", "source"):
        w = Window.orderBy(F.col(name).asc_nulls_first())
        # One row for each distinct value; the join is by value, and Spark picks its kind by the table's size.
        values = rows.groupBy(name).agg(F.count("*").alias("_n")).select(F.col(name).alias(f"_{name}"), (F.row_number().over(w) - 1).alias("_rank"))
        values = values.select(f"_{name}", F.floor(F.col("_rank").cast("long") * side / F.greatest(F.count("*").over(Window.partitionBy()), F.lit(side))).cast("int").alias(f"{name}_level"))
        rows = rows.join(values, F.col(name).eqNullSafe(F.col(f"_{name}")))
    level = F.shiftright(magnitude(F.col("n_chars")), 6 - bits) if bits <= 6 else F.shiftleft(magnitude(F.col("n_chars")), bits - 6)
    placed = rows.select("doc_id", *DIMENSIONS, F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0)).cast("long").alias("chars"), curve_index([F.col("lang_level"), F.col("source_level"), level], bits).alias("curve")).withColumn("block", F.floor(F.col("doc_id") / BLOCK))
    blocks = placed.groupBy("curve", "block").agg(F.sum("chars").alias("chars"))
    cells = blocks.groupBy("curve").agg(F.sum("chars").alias("chars"))
    # At most 2^(bits * dimensions) cells, so this one window is bounded whatever the corpus.
    before_cell = cells.select("curve", (F.sum("chars").over(Window.orderBy("curve")) - F.col("chars")).alias("cell_before"))
    before_block = blocks.join(before_cell, "curve").select(F.col("curve").alias("_curve"), F.col("block").alias("_block"), (F.col("cell_before") + F.sum("chars").over(Window.partitionBy("curve").orderBy(F.col("block").asc_nulls_first())) - F.col("chars")).alias("block_before"))
    inner = Window.partitionBy("curve", "block").orderBy(F.col("doc_id").asc_nulls_first(), "chars")
    within = placed.withColumn("before", F.coalesce(F.sum("chars").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = Window.partitionBy("curve", "block", "doc_id", "chars")
    within = within.withColumn("before", F.min("before").over(same))
    return within.join(before_block, (F.col("curve") == F.col("_curve")) & F.col("block").eqNullSafe(F.col("_block"))).select("doc_id", *DIMENSIONS, "curve", F.floor((F.col("block_before") + F.col("before")) / shard_chars).cast("long").alias("shard"))


def write_shards(docs: DataFrame, path: str, bits: int = BITS, shard_chars: int = SHARD_CHARS, parts: int | None = None) -> DataFrame:
    """Writes docs as Parquet, a file for each shard in a folder shard=N, and gives the shards' boxes.

    Rows of a file stand in curve order, then by doc_id, so that row groups within a file span small boxes as well. A row finds
    its shard by (doc_id, lang, source, n_chars), nulls included; rows equal in those share one. Texts are exchanged once.
    An empty table gives no file.
    """
    places = _placed(docs, bits, shard_chars).distinct()
    own = {c: fresh(docs, f"__{c}") for c in (*places.columns, "curve", "shard")}
    places = places.select(*[F.col(c).alias(own[c]) for c in places.columns])
    kinds = {"doc_id": "long", "n_chars": "long"}
    on = [F.col(c).cast(kinds.get(c, "string")).eqNullSafe(F.col(own[c])) for c in ("doc_id", *DIMENSIONS)]
    shard = fresh(docs, "shard")
    joined = docs.join(places, on[0] & on[1] & on[2] & on[3]).withColumn(shard, F.col(own["shard"]))
    spread = joined.repartition(parts, shard) if parts else joined.repartition(shard)
    spread.sortWithinPartitions(shard, own["curve"], own["doc_id"]).drop(own["curve"], own["shard"], *[own[c] for c in ("doc_id", *DIMENSIONS)]).write.partitionBy(shard).parquet(path)
    written = docs.sparkSession.read.parquet(path)
    return written.groupBy(shard).agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"), *[f(c).alias(f"{c}_{f.__name__}") for c in DIMENSIONS for f in (F.min, F.max)])


def shard_boxes(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """(shard, rows, chars, minima and maxima of each dimension), what a reader prunes files by. Rows without a doc_id aren't joined."""
    return shards.join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *DIMENSIONS).dropDuplicates(["doc_id"]), "doc_id").groupBy("shard").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"), *[f(c).alias(f"{c}_{f.__name__}") for c in DIMENSIONS for f in (F.min, F.max)])


def _oracle(bits: int = BITS, shard_chars: int = SHARD_CHARS) -> str:
    digits, following = tables(3)
    side = 1 << bits
    steps, last = [], "levels"
    for b in reversed(range(bits)):
        at = f"state * 8 + ((l0 >> {b}) & 1) + ((l1 >> {b}) & 1) * 2 + ((l2 >> {b}) & 1) * 4 + 1"
        steps.append(f"s{b} AS (SELECT doc_id, chars, l0, l1, l2, curve * 8 + {digits}[{at}] AS curve, {following}[{at}] AS state FROM {last})")
        last = f"s{b}"
    rank = lambda c: f"(SELECT {c} AS v, CAST(floor((row_number() OVER (ORDER BY {c} NULLS FIRST) - 1) * {side} / greatest(count(*) OVER (), {side})) AS INTEGER) AS level FROM (SELECT DISTINCT {c} FROM documents))"
    return f"""
WITH base AS (SELECT doc_id, lang, source, greatest(coalesce(n_chars, 0), 0) AS chars FROM documents),
levels AS (
  SELECT doc_id, chars, a.level AS l0, b.level AS l1,
    CAST(least(CASE WHEN chars < 2 THEN chars ELSE 2 * (length(bin(chars)) - 1) + ((chars >> (length(bin(chars)) - 2)) & 1) END, 63) AS INTEGER) >> {6 - bits} AS l2,
    CAST(0 AS BIGINT) AS curve, 0 AS state
  FROM base JOIN {rank('lang')} a ON lang IS NOT DISTINCT FROM a.v JOIN {rank('source')} b ON source IS NOT DISTINCT FROM b.v),
{', '.join(steps)}
SELECT doc_id, CAST(curve AS BIGINT) AS curve,
  CAST(floor((sum(chars) OVER (ORDER BY curve, doc_id NULLS FIRST, chars) - sum(chars) OVER (PARTITION BY curve, doc_id, chars)) / {shard_chars}) AS BIGINT) AS shard
FROM {last}"""


ORACLE = _oracle()
