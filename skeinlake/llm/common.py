"""Helpers that the text operators share: UTF-8 buffers as numpy arrays, word hashes, tables in the shared folder."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: UTF-8 bytes that one pass of a vectorised kernel takes; a longer text is a pass of its own.
CHUNK_BYTES = 500_000

_byte = np.arange(256)
_ascii_word = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122))
#: Letters, digits and every byte of a non-ASCII character belong to a word; texts with other than Latin-1 letters are rewritten so that this holds.
IS_WORD = _ascii_word | (_byte >= 128)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)

#: Scripts that put no spaces between words (Thai, Lao, Burmese, Khmer, Tai, Kana, Bopomofo, Han): each character is a word.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x303B), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)

#: Bytes of a word that are hashed in step with other words'.
LONG_WORD = 64
_BASE, _SEED = np.uint64(0x100000001B3), np.uint64(0xCBF29CE484222325)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path, on whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, whatever its own extra columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; on a single machine (tests) a temporary one where it is unset, on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def passing(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table between steps; it is deleted when the application ends."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage, and survives the loss of executors. The files go when the application ends."""
    path = passing(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null counts as an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    offsets = np.frombuffer(column.buffers()[1], kind, count=len(column) + 1, offset=column.offset * kind.itemsize) if len(column) else np.zeros(1, kind)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over Arrow batches that gives memory back to the system when a task ends: idle workers are kept for later tasks, and count while they wait."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library keeps its memory its own way
                pass

    return whole


def passes(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts come to about `limit` bytes; each row is in one of them, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S33)) * _M2
    return h ^ (h >> _S33)


def _powers(n: int) -> np.ndarray:
    """_BASE^0 .. _BASE^n."""
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters; texts with others come lower-cased from spaced()."""
    out = LOWER[data]
    if len(out) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][latin] += 0x20
    return out


@cache
def kinds() -> np.ndarray:
    """Of each code point: 1 in a word (letters, marks, numbers), 2 a word by itself, 0 between words."""
    out = np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)]).astype(np.uint8)
    for a, b in UNSPACED:
        out[a : b + 1] *= 2
    return out


def _plain(data: np.ndarray) -> bool:
    """Whether all that isn't ASCII is Latin-1 letters (0xC3 and a byte, without the signs of multiplication and division)."""
    if not (data >= 0x80).any():
        return True
    if (data[data >= 0xC0] != 0xC3).any():
        return False
    return not ((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))).any()


def spaced(text: str) -> bytes:
    """A text lower-cased (final sigma as any other), with a space for whatever isn't in a word and around each word of one character."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).copy()
    codes[codes == 0x3C2] = 0x3C3
    kind = kinds()[codes]
    codes[kind == 0] = 0x20
    each = np.where(kind == 2, 3, 1)
    out, at = np.repeat(codes, each), (np.cumsum(each) - each)[kind == 2]
    out[at] = out[at + 2] = 0x20
    return out.tobytes().decode("utf-32-le").encode()


def _between(data: np.ndarray, b: int) -> bool:
    """Whether texts may be cut before a byte: no word goes on there."""
    if data[b] < 0x80:
        return not IS_WORD[data[b]]
    return data[b] >= 0xC0 and kinds()[ord(data[b : b + 4].tobytes().decode("utf-8", "ignore")[0])] != 1


def _next_cut(data: np.ndarray, b: int, end: int) -> int:
    """The first place from b on before which texts may be cut, or the end."""
    while b < end:
        part = data[b : min(b + 65_536, end)]
        for k in np.flatnonzero(~IS_WORD[part] | (part >= 0xC0)).tolist():
            if _between(data, b + k):
                return b + k
        b += len(part)
    return end


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    base = int(offsets[0])
    text, at = data[base : int(offsets[-1])], offsets - base
    if not _plain(text):
        parts = [text[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        parts = [p.tobytes() if _plain(p) else spaced(p.tobytes().decode()) for p in parts]
        text, at = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    n = len(text)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = IS_WORD[text]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = at[(at > 0) & (at < n)]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    breaks = np.zeros(n + 1, bool)
    breaks[np.flatnonzero(~inside)] = True
    breaks[cut] = True
    breaks[n] = True
    edges = np.flatnonzero(breaks)
    ends = edges[np.searchsorted(edges, starts, "right")]
    size = ends - starts
    low = lowered(text)
    short = np.minimum(size, LONG_WORD)
    order = np.argsort(-short.astype(np.int16), kind="stable")
    s = starts[order]
    h = np.full(len(s), _SEED, np.uint64)
    # Words of at least k + 1 bytes come first, so each step takes the front of the list.
    active = np.cumsum(np.bincount(short, minlength=LONG_WORD + 2)[::-1])[::-1]
    for k in range(int(short.max()) if len(s) else 0):
        m = int(active[k + 1])
        h[:m] = h[:m] * _BASE + low[s[:m] + k]
    # The rest of a longer word in one go: the same polynomial.
    for place in np.flatnonzero(size[order] > LONG_WORD).tolist():
        a, b = int(s[place]) + LONG_WORD, int(s[place] + size[order[place]])
        for c in range(a, b, 1 << 20):
            part = low[c : min(c + (1 << 20), b)]
            power = _powers(len(part))
            h[place : place + 1] = h[place : place + 1] * power[-1:] + (part * power[-2::-1]).sum(dtype=np.uint64)
    out = np.empty_like(h)
    out[order] = mix(h)
    return out, np.searchsorted(starts, at)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts in order, and where the words of each text begin (one more entry than texts).

    Words are runs of letters, marks and numbers, lower-cased; in scripts without spaces each character is one.
    A text far beyond a pass is hashed piece by piece, cut between words, so that memory doesn't grow with it.
    """
    a, end = int(offsets[0]), int(offsets[-1])
    if end - a <= 4 * CHUNK_BYTES:
        return _words(data, offsets)
    hashes, begins = [], np.zeros(len(offsets), np.int64)
    while a < end:
        b = min(a + CHUNK_BYTES, end)
        b = _next_cut(data, b, end)
        h, at = _words(data, np.clip(offsets, a, b))
        hashes.append(h)
        begins += at
        a = b
    return np.concatenate(hashes), begins


def grams(hashes: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words and where those of each text begin. A text of 1 to n-1 words has one gram, of all its words."""
    count = np.diff(begins)
    each = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_begins = np.concatenate([[0], np.cumsum(each)])
    if not len(hashes):
        return np.zeros(0, np.uint64), out_begins
    doc = np.repeat(np.arange(len(count)), each)
    start = begins[:-1][doc] + (np.arange(out_begins[-1]) - out_begins[:-1][doc])
    width = np.minimum(count, n)[doc]
    h = np.zeros(len(start), np.uint64)
    for k in range(n):
        part = hashes[np.minimum(start + k, len(hashes) - 1)]
        h = np.where(k < width, h * _BASE + part, h)
    return mix(h), out_begins


def first_in_row(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Marks the first place of each value within its row (rows as slices of values, values small non-negative integers)."""
    place = np.arange(len(values), dtype=np.int32)
    keep = np.zeros(len(values), bool)
    seen = np.zeros(int(values.max()) + 1 if len(values) else 1, np.int32)
    for i in range(len(begins) - 1):
        a, b = int(begins[i]), int(begins[i + 1])
        v = values[a:b]
        seen[v[::-1]] = place[a:b][::-1]
        keep[a:b] = seen[v] == place[a:b]
    return keep
