"""Mixing sources to target weights by balanced sampling with the cube method.

Every document has an inclusion probability, so that each source is expected to give its share of the tokens. The flight
phase moves the vector of probabilities at random along directions in which the totals don't change, until all but as many
entries as there are totals are 0 or 1. Here the totals are a source's documents and tokens: three open entries and two
totals leave one direction, their cross product, so a step costs a few operations. Blocks of a source fly apart, then what they
left open flies together, and a landing of at most two documents for a source ends it.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import CHUNK_BYTES, fresh, kinds, passes, stored, utf8

#: Share of the corpus's tokens that the sample is to have.
SHARE = 0.5
#: Without given weights a source weighs as its tokens to this power: less than 1 lifts small sources.
TEMPERATURE = 0.5
#: Documents of a block on average. A block is one task's unit of the first flight; its bound keeps memory small.
BLOCK = 20_000
#: Blocks whose open documents fly together, before those that are left do.
JOINED = 10_000
_EPS = 1e-9


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves p in the null space of the totals sum(p) and sum(p * x) until at most two entries are strictly between 0 and 1."""
    p = p.astype(float).copy()
    scale = max(float(np.abs(x).max()), 1.0) if len(x) else 1.0
    v = (x / scale).tolist()
    q = p.tolist()
    draws = iter(rng.random(2 * len(q) + 8).tolist())
    open_ = [i for i in range(len(q)) if _EPS < q[i] < 1 - _EPS]
    active, at = open_[:3], 3
    while len(active) == 3:
        i, j, k = active
        # Orthogonal to (1, 1, 1) and to the tokens; equal tokens leave a direction of two entries.
        a, b, c = v[k] - v[j], v[i] - v[k], v[j] - v[i]
        if abs(a) < 1e-12 and abs(b) < 1e-12 and abs(c) < 1e-12:
            a, b, c = 1.0, -1.0, 0.0
        up = down = float("inf")
        for u, t in ((a, q[i]), (b, q[j]), (c, q[k])):
            if u > 0:
                up, down = min(up, (1 - t) / u), min(down, t / u)
            elif u < 0:
                up, down = min(up, -t / u), min(down, (t - 1) / u)
        # Up with the probability that keeps each entry's expectation.
        step = up if next(draws) * (up + down) < down else -down
        q[i], q[j], q[k] = q[i] + step * a, q[j] + step * b, q[k] + step * c
        active = [m for m in active if _EPS < q[m] < 1 - _EPS]
        while len(active) < 3 and at < len(open_):
            active.append(open_[at])
            at += 1
    out = np.array(q)
    out[out <= _EPS], out[out >= 1 - _EPS] = 0.0, 1.0
    return out


def land(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Ends a flight's result in 0 and 1, dropping the totals one by one: tokens first, then the number of documents."""
    p = p.astype(float).copy()
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    while len(open_) >= 2:
        i, j = open_[:2]
        up, down = min(1 - p[i], p[j]), min(p[i], 1 - p[j])
        step = up if rng.random() * (up + down) < down else -down
        p[i] += step
        p[j] -= step
        open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    for i in open_:
        p[i] = float(rng.random() < p[i])
    return np.round(p)


def _seed(*parts) -> np.random.Generator:
    import xxhash

    return np.random.default_rng(xxhash.xxh64_intdigest("\x1f".join(map(str, parts))))


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h", "doc_id"], kind="stable").reset_index(drop=True)
    pdf["p"] = flight(pdf["p"].to_numpy(), pdf["tokens"].to_numpy(float), _seed("flight", pdf["source"].iloc[0], pdf["block"].iloc[0]))
    return pdf


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h", "doc_id"], kind="stable").reset_index(drop=True)
    x, rng = pdf["tokens"].to_numpy(float), _seed("landing", pdf["source"].iloc[0])
    pdf["p"] = land(flight(pdf["p"].to_numpy(), x, rng), x, rng)
    return pdf


def _inside(text: np.ndarray) -> np.ndarray:
    """Which bytes, or code points, aren't white space."""
    return (text != 32) & (text != 9) & (text != 10) & (text != 13)


def _count(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of UTF-8 texts: runs without white space; in scripts without spaces each character is one."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j in passes(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        before = False
        # Only a text that is a pass by itself is longer than a piece.
        for c in range(a, b, 4 * CHUNK_BYTES):
            inside = _inside(data[c : min(c + 4 * CHUNK_BYTES, b)])
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            at = np.clip(offsets[i : j + 1], c, c + len(inside)) - c
            begins = at[:-1][at[:-1] < at[1:]]
            first[begins] = inside[begins]
            first[0] &= not before
            before = bool(inside[-1])
            out[i:j] += np.diff(np.concatenate([[0], np.cumsum(first)])[at])
        high = a + np.flatnonzero(data[a:b] >= 0xE0)
        for r in np.unique(np.searchsorted(offsets[i : j + 1], high, "right") - 1).tolist() if len(high) else []:
            text = data[int(offsets[i + r]) : int(offsets[i + r + 1])].tobytes().decode()
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            alone = kinds()[codes] == 2
            if alone.any():
                word = _inside(codes) & ~alone
                out[i + r] = int(alone.sum()) + int((word & ~np.concatenate([[False], word[:-1]])).sum())
    return out


def _tokens(text: pa.Array) -> pa.Array:
    return pa.array(_count(*utf8(text)))


def words(text: Column) -> Column:
    """Words of a text, as tokens are counted here: runs without white space; in scripts without spaces (Chinese, Japanese, Thai and others) each character is one. Null and empty texts have none."""
    return F.arrow_udf(_tokens, LongType())(text)


def probabilities(units: DataFrame, weights: Mapping[str, float] | None, share: float, temperature: float) -> DataFrame:
    """(source, p): tokens wanted of each source by its tokens, 1 at most; what a full source can't give goes to the others by weight.

    A source is full if its weight times a level is at least its tokens. The level rises until the sum is what is wanted; each
    step is one aggregation over the table of sources, of which only the level comes to the driver.
    """
    spark = units.sparkSession
    totals = units.groupBy("source").agg(F.sum("tokens").cast("double").alias("t"))
    if weights is None:
        totals = totals.withColumn("w", F.when(F.col("t") > 0, F.pow("t", F.lit(temperature))).otherwise(0.0))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "_source string, w double")
        totals = totals.join(given, F.col("source") == F.col("_source"), "left").select("source", "t", F.coalesce("w", F.lit(0.0)).alias("w"))
    totals = stored(totals, "mix-totals")
    level, before = 0.0, -1.0
    while level != before:
        before = level
        full = F.col("w") * F.lit(level) >= F.col("t")
        useful = (F.col("t") > 0) & (F.col("w") > 0)
        whole, given, free = totals.agg(F.sum("t"), F.sum(F.when(useful & full, F.col("t"))), F.sum(F.when(useful & ~full, F.col("w")))).first()
        left = share * (whole or 0.0) - (given or 0.0)
        if not free or left <= 0:
            break
        level = max(level, left / free)
    sure = F.lit(1.0) if weights is None else F.when(F.col("w") > 0, 1.0).otherwise(0.0)
    p = F.when(F.col("t") > 0, F.least(F.lit(1.0), F.lit(level) * F.col("w") / F.col("t"))).otherwise(sure)
    return totals.select("source", p.alias("p"))


def balanced_sample(docs: DataFrame, weights: Mapping[str, float] | None = None, share: float = SHARE, temperature: float = TEMPERATURE, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, tokens, p, selected), a row for each doc_id of docs: its inclusion probability and whether it is drawn.

    weights: a source's share of the sample's tokens, to scale (a source that isn't named weighs 0); without them tokens to
    the power of temperature. A unit is a doc_id: its rows are drawn together, their tokens (words) summed, and it
    belongs to the least of its sources (null counts as a source of its own). Null ids can't be drawn and have no row. Texts
    that are null or empty have 0 tokens; a source of only such is kept whole. Draws depend on ids, sources and tokens
    alone, not on partitions, so a task that runs again draws the same.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("tokens"))
    units = rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("tokens").alias("tokens"))
    return _drawn(units, weights, share, temperature, block)


def _drawn(units: DataFrame, weights, share: float, temperature: float, block: int) -> DataFrame:
    units = stored(units, "mix-units")
    p = probabilities(units, weights, share, temperature)
    blocks = max(1, -(-units.count() // block))
    # The table of sources is bounded by their number; Spark joins it as its size suggests.
    rows = units.join(p.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("h", F.xxhash64("doc_id")).withColumn("block", F.pmod("h", F.lit(blocks)).cast("long"))
    sure = (F.col("p") <= 0) | (F.col("p") >= 1)
    schema = "doc_id long, source string, tokens long, base double, p double, h long, block long"
    rows = rows.withColumn("base", F.col("p")).select("doc_id", "source", "tokens", "base", "p", "h", "block")
    first = stored(rows.where(~sure).groupBy("source", "block").applyInPandas(_fly, schema), "mix-flight")
    still = (F.col("p") > 0) & (F.col("p") < 1)
    while blocks > JOINED:
        # So many blocks leave more open documents than one task should take: they fly in larger blocks first.
        blocks = -(-blocks // JOINED)
        again = first.where(still).withColumn("block", F.pmod("block", F.lit(blocks)))
        first = stored(first.where(~still).unionByName(again.groupBy("source", "block").applyInPandas(_fly, schema)), "mix-flight")
    landed = first.where(still).groupBy("source").applyInPandas(_land, schema)
    return rows.where(sure).unionByName(first.where(~still)).unionByName(landed).select("doc_id", "source", "tokens", F.col("base").alias("p"), (F.col("p") > 0.5).alias("selected"))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, share: float = SHARE, temperature: float = TEMPERATURE, block: int = BLOCK) -> DataFrame:
    """The rows of docs whose doc_id balanced_sample draws, with docs' own columns. Rows of one doc_id are drawn together; rows with a null doc_id can't be drawn and go."""
    key = fresh(docs, "__drawn")
    chosen = balanced_sample(docs, weights, share, temperature, block).where("selected").select(F.col("doc_id").alias(key))
    return docs.join(chosen, F.col("doc_id").cast("long") == F.col(key), "left_semi")
