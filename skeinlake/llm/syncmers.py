"""Closed syncmers: the k-mers of a text whose least inner s-mer is the first or the last one.

Whether a k-mer is chosen depends on its own characters alone, so a passage that two documents share gives the same anchors
in both, whatever surrounds it; the positions tell how the passages lie to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, passes, trimmed, utf8

#: Characters of an anchor and of the inner substrings. About 2 in K - S + 1 k-mers are chosen, and of any K - S in a row at least one (leaving out low-complexity ties).
K, S = 32, 12
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters from each place on."""
    m = max(len(codes) - n + 1, 0)
    h, width, done = codes.astype(np.uint64) + np.uint64(1), 1, []
    # Doubling: the hash of 2w characters from two of w.
    while n:
        if n & 1:
            done.append((width, h))
        n >>= 1
        if n:
            h = h[: max(len(h) - width, 0)] * _power(width) + h[width:]
            width *= 2
    out, at = np.zeros(m, np.uint64), 0
    for w, part in done:
        out = out * _power(w) + part[at : at + m]
        at += w
    return mix(out)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row."""
    width, out = 1, x
    while width * 2 <= n:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def syncmers(codes: np.ndarray, k: int = K, s: int = S, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the closed syncmers of a sequence of characters. Of equal inner hashes each counts as the least. Blocks overlap by k - 1 characters, so cutting changes nothing."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a in range(0, len(codes) - k + 1, block):
        part = codes[a : a + block + k - 1]
        inner = _rolling(part, s)
        least = _sliding_min(inner, k - s + 1)
        n = len(least)
        at = np.flatnonzero((inner[:n] == least) | (inner[k - s : k - s + n] == least))
        places.append(at + a)
        hashes.append(_rolling(part, k)[at])
    return np.concatenate(places), np.concatenate(hashes)


def _anchors(k: int, s: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            valid = np.asarray(texts.is_valid())
            _, offsets = utf8(texts)
            for i, j in passes(offsets):
                part = texts.slice(i, j - i)
                size = pc.fill_null(pc.utf8_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                edge = np.concatenate([[0], np.cumsum(size)])
                data, off = utf8(part)
                codes = np.frombuffer(data[off[0] : off[-1]].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
                at, hashes = syncmers(codes, k, s)
                # A k-mer belongs to the text that holds its start, if it ends there too.
                row = np.searchsorted(edge, at, "right") - 1
                inside = at + k <= edge[row + 1] if len(at) else np.zeros(0, bool)
                at, hashes, row = at[inside], hashes[inside], row[inside]
                begins = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                hide = pa.array(~valid[i:j])
                lists = lambda v: pa.ListArray.from_arrays(pa.array(begins), pa.array(v), mask=hide)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists((at - edge[row]).astype(np.int32)), lists(hashes.view(np.int64))], ["doc_id", "positions", "hashes"])

    return run


def closed_syncmers(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, positions, hashes) for each row of docs: the character offsets of its anchors in ascending order and their 64-bit hashes.

    A text of fewer than k characters, the empty one too, has empty lists; a null text null ones. Null ids stay, repeated
    rows are each fingerprinted. In runs of one character every k-mer ties and is chosen.
    """
    if not 0 < s < k:
        raise ValueError("s must lie between 0 and k")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_anchors(k, s)), "doc_id long, positions array<int>, hashes array<long>")


def matches(left: DataFrame, right: DataFrame, least: int = 2) -> DataFrame:
    """(left_id, right_id, shift, anchors) of two tables of fingerprints: how many anchors two documents share at one shift of positions.

    An anchor that a document has more than once counts at each pair of places. Rows without anchors match nothing.
    """
    flat = lambda df, name: df.select(F.col("doc_id").alias(f"{name}_id"), F.explode(F.arrays_zip("hashes", "positions")).alias("a")).select(f"{name}_id", F.col("a.hashes").alias("hash"), F.col("a.positions").alias(f"{name}_at"))
    return flat(left, "left").join(flat(right, "right"), "hash").groupBy("left_id", "right_id", (F.col("left_at") - F.col("right_at")).alias("shift")).agg(F.count("*").alias("anchors")).where(F.col("anchors") >= least)
