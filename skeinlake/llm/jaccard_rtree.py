"""N-gram Jaccard self-join, exact: blocks of rare grams, an R-tree over count vectors in each tile, verification on grams.

A document is the set of its word n-grams, equal sets are one class. All grams have one order: those that a sample has often
come last, by their count, the others first, by their hash. Two sets of the threshold share a gram within the first
n - ceil(t n) + 1 of each (the prefix), whatever the order is: so classes that share a gram of their prefixes meet, and no pair
is missed. The order only decides how many others meet as well. A pair is taken at the first grams that it shares, and only if
its sizes and the places of that gram leave enough for the threshold. Where the threshold needs several grams within the
prefixes, as it does in all but small or unlike sets, it must have MEETS of them; its first ones are always counted. Grams
that only sets of too unlike sizes share aren't listed.

Pairs that met go to tiles, mostly one for each cluster. There the grams of a set are hashed into GROUPS groups, and the counts
of the groups are a point. No two sets overlap by more than the sum of the coordinate minima of their points, and none in two
nodes of an R-tree by more than that of the nodes' upper corners; what is below the need is dropped, the rest is verified
on the grams themselves.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, grams, mix, passes, stored, trimmed, utf8, words

#: Words of a gram, and the least Jaccard similarity.
N, THRESHOLD = 3, 0.5
GROUPS = 256
#: Entries of an R-tree's leaf, and sets of a tile's part: larger tiles are joined part by part in separate tasks.
LEAF, TILE = 16, 2048
#: The order of grams: sets that are looked at, grams of one of these at most, and grams that come last at most. It is no limit of the join.
SAMPLE, SAMPLE_GRAMS, OFTEN = 12_000, 2000, 200_000
#: Bits of a gram's hash that are kept (32 + 8), postings of a bucket, and shared grams that a posting remembers before itself.
LOW_BITS, POSTINGS, BEFORE = 8, 2_000_000, 3
#: Parts of the buckets whose postings are exchanged one after another: so much less of them is on disk at once.
ROUNDS = 2
#: Sets of at most so many grams take 5 bytes a gram, larger ones less.
SHORT = 37
#: Sets of a gram that are compared two by two before their postings are sent; those of a gram that more have are sent unseen.
MATES = 16
#: Columns of postings that are compressed; numbers of documents as differences.
SMALL = ("docs", "places", "levels", "sizes", "left")
#: Grams of the prefixes that a pair must have in common, if it needs that many to reach the threshold.
MEETS = 2
#: Steps of a doubling of sizes that postings tell apart, and (tile, set) rows that are sent to all tasks (10 bytes each): beyond, sets and rows are joined.
STEPS, HOMES = 8, 4_000_000

_OTHER = np.uint64(0x5851F42D4C957F2D)
_LOW = np.uint64(LOW_BITS)


def _pack(keys: np.ndarray) -> bytes:
    """Gram hashes of 40 bits: their upper 32, and then the lower 8."""
    return (keys >> _LOW).astype(np.uint32).tobytes() + keys.astype(np.uint8).tobytes()


def _unpack(tokens) -> np.ndarray:
    n = len(tokens) // 5
    return np.frombuffer(tokens, np.uint32, n).astype(np.uint64) << _LOW | np.frombuffer(tokens, np.uint8, n, 4 * n)


def pack_set(keys: np.ndarray) -> bytes:
    """Sorted gram hashes of 40 bits: their lower 32, and then the upper 8 as a bit for each gram and one for each step of these."""
    if len(keys) <= SHORT:
        return _pack(keys)
    bits = np.zeros(len(keys) + 256, bool)
    bits[(keys >> np.uint64(32)).astype(np.int64) + np.arange(len(keys))] = True
    return keys.astype(np.uint32).tobytes() + np.packbits(bits).tobytes()


def unpack_set(tokens) -> np.ndarray:
    if len(tokens) <= 5 * SHORT:
        return _unpack(tokens)
    n = (len(tokens) - 32) * 8 // 33
    upper = np.flatnonzero(np.unpackbits(np.frombuffer(tokens, np.uint8, offset=4 * n), count=n + 256)) - np.arange(n)
    return upper.astype(np.uint64) << np.uint64(32) | np.frombuffer(tokens, np.uint32, n)


def _sets(n: int):
    """Per document: a number of its own, gram count, set hash, a second one, sorted gram hashes; no grams for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in passes(offsets):
                g, begins = grams(*words(data, offsets[i : j + 1]), n)
                sizes, sid, check, tokens = [], [], [], []
                for d in range(j - i):
                    whole = np.unique(g[begins[d] : begins[d + 1]])
                    sizes.append(len(whole))
                    sid.append((whole * (whole >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64) ^ np.uint64(len(whole)))
                    check.append(mix(whole ^ _OTHER).sum(dtype=np.uint64))
                    tokens.append(pack_set(whole >> np.uint64(24)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.arange(number, number + j - i)), pa.array(sizes, pa.int32()), pa.array(np.array(sid, np.uint64).view(np.int64)), pa.array(np.array(check, np.uint64).view(np.int64)), pa.array(tokens, pa.binary())], ["doc_id", "id", "n", "sid", "check", "tokens"])
                number += j - i

    return run


class Node:
    """A node of a bulk-loaded R-tree: the upper corner of its points, the span of its set sizes, its rows or children."""

    __slots__ = ("corner", "least", "most", "rows", "children")

    def __init__(self, corner, least, most, rows, children):
        self.corner, self.least, self.most, self.rows, self.children = corner, least, most, rows, children


def tree(points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF) -> Node:
    """Packs points, ordered by size and then by their heaviest group, into leaves, and those into nodes of as many children."""
    order = np.lexsort((points.argmax(1), sizes))
    level = [Node(points[r].max(0), int(sizes[r].min()), int(sizes[r].max()), r, None) for r in (order[k : k + leaf] for k in range(0, len(order), leaf))]
    while len(level) > 1:
        level = [Node(np.max([c.corner for c in part], 0), min(c.least for c in part), max(c.most for c in part), None, part) for part in (level[k : k + leaf] for k in range(0, len(level), leaf))]
    return level[0]


def needed(a, b, threshold: float):
    """The overlap that sets of these sizes need at least."""
    return threshold / (1 + threshold) * (a + b) - 1e-9


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of coordinate minima of points, or corners; a count of 255 may stand for more, and then nothing is known."""
    low = np.minimum(a, b)
    return np.where((low == 255).any(-1), np.inf, low.sum(-1, dtype=np.int64))


def surviving(points: np.ndarray, sizes: np.ndarray, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose bound reaches what they need; with side, one row of each side."""
    out_a, out_b = [], []
    if side is None:
        root = tree(points, sizes)
        stack = [(root, root)]
    else:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)

        def sub(rows: np.ndarray) -> Node:
            root = tree(points[rows], sizes[rows])
            todo = [root]
            for node in todo:
                if node.rows is not None:
                    node.rows = rows[node.rows]
                else:
                    todo += node.children
            return root

        stack = [(sub(left), sub(right))]
    while stack:
        a, b = stack.pop()
        if a.most < threshold * b.least or b.most < threshold * a.least or a is not b and bound(a.corner, b.corner) < needed(a.least, b.least, threshold):
            continue
        if a.rows is not None and b.rows is not None:
            ra, rb = a.rows, b.rows
            sa, sb = sizes[ra][:, None], sizes[rb][None, :]
            ok = (bound(points[ra][:, None, :], points[rb][None, :, :]) >= needed(sa, sb, threshold)) & (sa >= threshold * sb) & (sb >= threshold * sa)
            if a is b:
                ok = np.triu(ok, 1)
            x, y = np.nonzero(ok)
            out_a.append(ra[x])
            out_b.append(rb[y])
        elif a is b:
            stack += [(x, y) for k, x in enumerate(a.children) for y in a.children[k:]]
        elif a.rows is None and (b.rows is not None or a.most >= b.most):
            stack += [(x, b) for x in a.children]
        else:
            stack += [(a, y) for y in b.children]
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(out_a or empty), np.concatenate(out_b or empty)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows equal in the first columns, of batches sorted by them; a group may cross batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield held[0] if len(held) == 1 else pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield held[0] if len(held) == 1 else pa.concat_tables(held)


def prefix(n: np.ndarray, threshold: float) -> np.ndarray:
    """Of how many first grams of a set one is shared with any set that it reaches the threshold with."""
    return np.clip(n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0, n)


def often(samples: list, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Grams that several of these sets have, sorted, and their ranks: the more sets, the later they come."""
    if not samples:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.unique(np.concatenate([unpack_set(t) for t in samples]), return_counts=True)
    top = np.flatnonzero(counts >= least)
    top = np.sort(top[np.argsort(-counts[top], kind="stable")[:OFTEN]])
    return keys[top], counts[top].astype(np.int64)


def _ranks(keys: np.ndarray, late: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Place classes of grams in the order of all grams: 0, or the rank of one that comes late."""
    if not len(late[0]):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(late[0], keys), len(late[0]) - 1)
    return np.where(late[0][at] == keys, late[1][at], 0)


def _small(values: np.ndarray, steps: bool = False) -> bytes:
    """Integers compressed, first bytes first; with steps their differences."""
    if steps:
        values = np.diff(values, prepend=values.dtype.type(0))
    return pa.compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _whole(data: bytes, size: int, kind, steps: bool = False) -> np.ndarray:
    """What _small() compressed."""
    kind = np.dtype(kind)
    planes = np.frombuffer(pa.decompress(data, size * kind.itemsize, "zstd", asbytes=True), np.uint8).reshape(kind.itemsize, size)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if steps else values


def _packed(head: list[np.ndarray], columns: list[np.ndarray], names: list[str], small: tuple[str, ...] = SMALL) -> Iterator[pa.RecordBatch]:
    """A row for each run of equal heads of postings, with their columns as bytes, some compressed."""
    change = np.ones(len(head[0]), bool)
    change[1:] = np.any([h[1:] != h[:-1] for h in head], axis=0)
    starts = np.flatnonzero(change)
    if not len(starts):
        return
    edges = [*starts.tolist(), len(change)]
    blobs = [pa.array([_small(c[x:y], name == "docs") if name in small else c[x:y].tobytes() for x, y in zip(edges, edges[1:])], pa.binary()) for name, c in zip(names[len(head) :], columns)]
    yield pa.RecordBatch.from_arrays([*(pa.array(h[starts].astype(np.int64)) for h in head), *blobs], names)


def _flat(group: pa.Table, name: str, kind) -> np.ndarray:
    """A column of the postings of these rows; a plain one is the same for all postings of a row."""
    if kind is None:
        return np.repeat(group[name].to_numpy(), [len(v) // 4 for v in group["keys"].to_pylist()])
    if name in SMALL:
        return np.concatenate([np.zeros(0, kind), *(_whole(v, len(k) // 4, kind, name == "docs") for v, k in zip(group[name].to_pylist(), group["keys"].to_pylist()))])
    return np.frombuffer(b"".join(group[name].to_pylist()), kind)


def _buckets(keys: np.ndarray, spread: int) -> np.ndarray:
    """The lower bits of a gram, and `spread` upper ones: with the other 32 bits these are all of it."""
    return (keys & np.uint64((1 << LOW_BITS) - 1) | keys >> np.uint64(LOW_BITS + 32 - spread) << _LOW).astype(np.int64)


def _postings(late: tuple[np.ndarray, np.ndarray], threshold: float, spread: int, listed: dict[int, bytes], part: int = 0, parts: int = 1):
    """Rows (id, n, tokens) whose bit is set in these maps give the prefixes' grams, of this part of the buckets, packed by bucket and 65,536 documents: 32 bits, the document's, the place in 256ths of n, and n in STEPS of a doubling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _wanted(listed)(batches):
            ids, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            ends = np.cumsum(sizes, dtype=np.int64)
            cut = 0
            while cut < len(ids):
                stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + POSTINGS // 4, "right")))
                n = sizes[cut:stop].astype(np.int64)
                keys = np.concatenate([unpack_set(batch.column(2)[k].as_buffer()) for k in range(cut, stop)])
                doc = np.repeat(np.arange(stop - cut), n)
                rank = _ranks(keys, late)
                order = np.argsort(doc * (rank.max(initial=0) + 1) + rank, kind="stable")
                place = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
                keep = place < np.repeat(prefix(n, threshold), n)
                keys, doc, place = keys[order][keep], doc[keep], place[keep]
                own = keys % np.uint64(parts) == part
                keys, doc, place = keys[own], doc[own], place[own]
                q, bucket, own, level = place * 256 // n[doc], _buckets(keys, spread), ids[cut:stop][doc], np.floor(STEPS * np.log2(n))[doc]
                order = np.lexsort((own >> 16, bucket))
                yield from _packed([bucket[order], own[order] >> 16], [(keys[order] >> _LOW).astype(np.uint32), (own[order] & 0xFFFF).astype(np.uint16), q[order].astype(np.uint8), level[order].astype(np.uint8)], ["bucket", "batch", "keys", "docs", "places", "levels"])
                cut = stop

    return run


def common(keys: np.ndarray, levels: np.ndarray, threshold: float) -> np.ndarray:
    """Marks postings whose gram another set has as well, of a size that may reach the threshold with theirs."""
    # Of the sets with a gram the nearest in size are next to each other; a step more than the threshold's, as levels are rounded.
    both = keys.astype(np.uint64) << np.uint64(8) | levels.astype(np.uint64)
    order = np.argsort(both, kind="stable")
    both = both[order]
    same = (both[1:] >> np.uint64(8) == both[:-1] >> np.uint64(8)) & (both[1:] - both[:-1] <= np.uint64(math.floor(-STEPS * math.log2(threshold)) + 1))
    some = np.zeros(len(keys), bool)
    some[order[1:][same]] = some[order[:-1][same]] = True
    return some


def useful(keys: np.ndarray, levels: np.ndarray, places: np.ndarray, threshold: float) -> np.ndarray:
    """Marks postings at which some pair may be taken: what follows there in both sets, and fewer than MEETS grams before, is enough for the threshold. Of a gram that over MATES sets have all are marked."""
    order = np.argsort(keys, kind="stable")
    keys, level, part = keys[order], levels[order].astype(np.float64), threshold / (1 + threshold)
    least, most = 2 ** (level / STEPS) * (1 - 1e-9), 2 ** ((level + 1) / STEPS) * (1 + 1e-9)
    # The largest other set with which this one may reach the threshold.
    over = 1 - places[order] / 256 - part
    reach = np.minimum((MEETS - 1 + over * np.where(over > 0, most, least)) / part + 1e-6, most / threshold)
    change = np.ones(len(keys), bool)
    change[1:] = keys[1:] != keys[:-1]
    size = np.diff(np.append(np.flatnonzero(change), len(keys)))
    some = np.repeat(size > MATES, size)
    a = np.flatnonzero(~some)
    for step in range(1, MATES):
        a = a[a + step < len(keys)]
        a = a[keys[a] == keys[a + step]]
        near = a[(least[a] <= reach[a + step]) & (least[a + step] <= reach[a])]
        some[near] = some[near + step] = True
    out = np.zeros(len(keys), bool)
    out[order] = some
    return out


def _shared(threshold: float):
    """Postings sorted by bucket: those whose gram another document of a size near enough has as well, in the same form without levels, apart by whether they are useful."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            keys, docs, places, levels = _flat(group, "keys", np.uint32), _flat(group, "docs", np.uint16), _flat(group, "places", np.uint8), _flat(group, "levels", np.uint8)
            batch = _flat(group, "batch", None)
            kept = np.flatnonzero(common(keys, levels, threshold))
            use = np.zeros(len(keys), bool)
            use[kept] = useful(keys[kept], levels[kept], places[kept], threshold)
            kept = kept[np.lexsort((docs[kept], use[kept], batch[kept]))]
            yield from _packed([np.full(len(kept), group["bucket"][0].as_py(), np.int64), batch[kept], use[kept]], [keys[kept], docs[kept], places[kept]], ["bucket", "batch", "use", "keys", "docs", "places"])

    return run


def _listed(late: tuple[np.ndarray, np.ndarray]):
    """Rows (batch, kind, doc, n, bucket, use, keys, docs, places) sorted by batch and kind, classes (0) before postings (1), give of each class the shared grams of its prefix, in order, their places, and which are useful as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            first = group["kind"].to_numpy() == 0
            size = np.zeros(1 << 16, np.int64)
            size[group["doc"].to_numpy()[first]] = group["n"].to_numpy()[first]
            posts = group.filter(pa.array(~first))
            if not posts.num_rows:
                continue
            docs, places = _flat(posts, "docs", np.uint16), _flat(posts, "places", np.uint8)
            bucket, use = _flat(posts, "bucket", None), _flat(posts, "use", None) > 0
            keys = _flat(posts, "keys", np.uint32).astype(np.uint64) << _LOW | bucket.astype(np.uint64) & np.uint64((1 << LOW_BITS) - 1)
            order = np.lexsort((keys, _ranks(keys, late), docs))
            docs, places, keys, use = docs[order], places[order], keys[order], use[order]
            own, starts = np.unique(docs, return_index=True)
            edges = [*starts.tolist(), len(docs)]
            ids = (group["batch"][0].as_py() << 16) + own.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size[own], pa.int32()), pa.array([_pack(keys[x:y]) for x, y in zip(edges, edges[1:])], pa.binary()), pa.array([places[x:y].tobytes() for x, y in zip(edges, edges[1:])], pa.binary()), pa.array([np.packbits(use[x:y]).tobytes() for x, y in zip(edges, edges[1:])], pa.binary()), pa.array([keys[x:y].astype(np.uint16).tobytes() for x, y in zip(edges, edges[1:])], pa.binary())], ["id", "n", "tokens", "places", "use", "short"])

    return run


def _remembered(spread: int):
    """Rows (id, n, tokens, places, use) give their useful postings by bucket, each with its set's size, how many shared grams follow, and those before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            if not len(ids):
                continue
            lists = [_unpack(t.as_buffer()) for t in batch.column(2)]
            keys, places = np.concatenate(lists), np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8)
            doc = np.repeat(np.arange(len(ids)), [len(k) for k in lists])
            upper = (keys >> _LOW).astype(np.uint32)
            before = np.zeros((len(doc), BEFORE), np.uint32)
            for k in range(1, BEFORE + 1):
                before[k:, k - 1] = np.where(doc[k:] == doc[:-k], upper[:-k], 0)
            # How many grams of its list come after each.
            left = np.concatenate([np.arange(len(k) - 1, -1, -1, dtype=np.int32) for k in lists])
            bucket, own = _buckets(keys, spread), ids[doc]
            use = np.flatnonzero(np.concatenate([np.unpackbits(np.frombuffer(u, np.uint8), count=len(k)) for u, k in zip(batch.column(4).to_pylist(), lists)]))
            order = use[np.lexsort((own[use] >> 16, bucket[use]))]
            yield from _packed([bucket[order], own[order] >> 16], [upper[order], (own[order] & 0xFFFF).astype(np.uint16), places[order], sizes[doc[order]].astype(np.int32), left[order], before[order]], ["bucket", "batch", "keys", "docs", "places", "sizes", "left", "before"])

    return run


def met(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, left: np.ndarray, before: np.ndarray, threshold: float, step: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of ids that share a key, and the weight of that, unless they can't reach the threshold or have met at MEETS keys before. places are lower bounds; keys in order, ids of a key in any.

    Weights of all keys come to MEETS at least for each pair of the threshold: its first MEETS common keys, or all that it needs, are never left out.
    """
    change = np.ones(len(keys), bool)
    change[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(keys))
    # Each posting with those after it of its key.
    mates = np.repeat(ends, ends - starts) - np.arange(len(keys)) - 1
    total = np.concatenate([[0], np.cumsum(mates)])
    rest = sizes - prefix(sizes, threshold)
    for s in range(0, int(total[-1]), step):
        at = np.arange(s, min(s + step, int(total[-1])))
        a = np.searchsorted(total, at, "right") - 1
        b = a + 1 + at - total[a]
        na, nb = sizes[a], sizes[b]
        need = needed(na, nb, threshold)
        ok = (ids[a] != ids[b]) & (na >= threshold * nb) & (nb >= threshold * na) & (MEETS - 1 + np.minimum(na - places[a], nb - places[b]) >= need)
        # Grams in common are this one and fewer than MEETS before it, others of both lists, and what follows the prefix that ends first.
        after = np.maximum(rest[a], rest[b])
        ok &= MEETS + np.minimum(left[a], left[b]) + after >= need
        a, b, lack = a[ok], b[ok], (need - after)[ok]
        known = np.zeros(len(a), np.int8)
        for x in range(BEFORE):
            for y in range(BEFORE):
                known += (before[a, x] == before[b, y]) & (before[a, x] != 0)
            new = known < MEETS
            a, b, lack, known = a[new], b[new], lack[new], known[new]
        if len(a):
            yield np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), -(-MEETS // np.clip(np.ceil(lack), 1, MEETS).astype(np.int64))


def _meeting(threshold: float):
    """Postings sorted by bucket give pairs of ids and weights; a pair may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            keys, docs = _flat(group, "keys", np.uint32), _flat(group, "docs", np.uint16)
            sizes, left, before = _flat(group, "sizes", np.int32).astype(np.int64), _flat(group, "left", np.int32), _flat(group, "before", np.uint32).reshape(-1, BEFORE)
            ids = _flat(group, "batch", None) << 16 | docs
            # The least place that the 256ths stand for.
            places = -(-_flat(group, "places", np.uint8).astype(np.int64) * sizes // 256)
            order = np.argsort(keys, kind="stable")
            for a, b, weight in met(keys[order], ids[order], sizes[order], places[order], left[order], before[order], threshold):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(weight)], ["a", "b", "weight"])

    return run


def _wanted(ids: dict[int, bytes]):
    """Of rows whose first column is a document's number those whose bit is set in these maps of 65,536 each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            keep = np.zeros(len(own), bool)
            for k in np.unique(own >> 16).tolist():
                if k in ids:
                    of = own >> 16 == k
                    keep[of] = np.unpackbits(np.frombuffer(ids[k], np.uint8))[own[of] & 0xFFFF] > 0
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers sorted by themselves: maps of the bits that they set, of 65,536 each."""
    last, held = None, np.zeros(1 << 16, bool)
    row = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([np.packbits(held).tobytes()], pa.binary())], ["batch", "bits"])
    for batch in batches:
        own = batch.column(0).to_numpy()
        for k in np.unique(own >> 16).tolist():
            if k != last and last is not None:
                yield row()
                held[:] = False
            last = k
            held[own[own >> 16 == k] & 0xFFFF] = True
    if last is not None:
        yield row()


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, tile) sorted by id: of each 65,536 ids a row, with the lower bits and the tiles as bytes."""
    for batch in batches:
        ids, tiles = (batch.column(k).to_numpy() for k in range(2))
        yield from _packed([ids >> 16], [(ids & 0xFFFF).astype(np.uint16), tiles], ["batch", "docs", "tiles"], ())


def _sent(homes: dict[int, list[tuple[bytes, bytes]]]):
    """Rows (id, ...) give one for each of their tiles, which comes first; rows without one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {k: (np.frombuffer(b"".join(d for d, _ in v), np.uint16), np.frombuffer(b"".join(t for _, t in v), np.int64)) for k, v in homes.items()}
        orders = {k: np.argsort(d, kind="stable") for k, (d, _) in lists.items()}
        lists = {k: (d[orders[k]], t[orders[k]]) for k, (d, t) in lists.items()}
        for batch in batches:
            own = batch.column(0).to_numpy()
            for k in np.unique(own >> 16).tolist():
                if k not in lists:
                    continue
                rows = np.flatnonzero(own >> 16 == k)
                docs, tiles = lists[k]
                low = (own[rows] & 0xFFFF).astype(np.uint16)
                start = np.searchsorted(docs, low)
                times = np.searchsorted(docs, low, "right") - start
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - start, times)
                rows = np.repeat(rows, times)
                for x in range(0, len(rows), 256):
                    part = batch.take(pa.array(rows[x : x + 256]))
                    yield pa.RecordBatch.from_arrays([pa.array(tiles[at[x : x + 256]]), *part.columns], ["tile", *part.schema.names])

    return run


def _verify(threshold: float, forest: bool = False, look: bool = False):
    """Rows (tile, kind, a, b, rep, n, tokens) sorted by tile and kind, sets (0) before pairs (1), give verified pairs: those that an R-tree of the tile leaves, or, where few of a tile's sets have met, the bound of their points, are counted; with forest only those that connect what no earlier pair of the tile does, and others aren't looked at. With look the sets are 16 bits of each shared gram of the prefixes, so that counts can only be too high, and pairs stay whose common ones leave enough for the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, where, reps, sets, sizes = None, {}, [], [], []
        flat = None
        for batch in batches:
            tiles, kinds, a_, b_, rep_, n_ = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            tokens = batch.column(6)
            bounds = [0, *(np.flatnonzero((tiles[1:] != tiles[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(tiles)] if len(tiles) else []
            for x, y in zip(bounds, bounds[1:]):
                if tiles[x] != tile:
                    tile, where, reps, sets, sizes, flat = tiles[x], {}, [], [], [], None
                if kinds[x] == 0:
                    for k in range(x, y):
                        if a_[k] not in where:
                            where[a_[k]] = len(reps)
                            reps.append(int(rep_[k]))
                            sizes.append(int(n_[k]))
                            sets.append(np.frombuffer(tokens[k].as_buffer(), np.uint16) if look else unpack_set(tokens[k].as_buffer()))
                    continue
                if flat is None:
                    size_ = np.array([len(s) for s in sets])
                    edge = np.concatenate([[0], np.cumsum(size_)])
                    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
                    stride = max(1, 1_000_000 // max(int(size_.max()), 1))
                    mark, total, rep = np.zeros(int(flat.max()) + 1, bool), np.array(sizes), np.array(reps, np.int64)
                    name = np.array(list(where), np.int64)
                    part = np.arange(len(sets))
                    points = None if look else np.array([np.minimum(np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), 255) for s in sets], np.uint8)
                    near, rest = None, total - prefix(total, threshold)
                ia = np.array([where[v] for v in a_[x:y]])
                ib = np.array([where[v] for v in b_[x:y]])
                if not look and near is None and 4 * len(ia) >= len(sets) ** 2:
                    lower, upper = surviving(points, total, None, threshold)
                    near = np.zeros((len(sets), len(sets)), bool)
                    near[lower, upper] = near[upper, lower] = True
                if near is not None:
                    ok = near[ia, ib]
                elif look:
                    ok = np.ones(len(ia), bool)
                else:
                    ok = np.concatenate([bound(points[ia[k : k + 10_000]], points[ib[k : k + 10_000]]) for k in range(0, len(ia), 10_000)]) >= needed(total[ia], total[ib], threshold)
                ia, ib = ia[ok], ib[ok]
                if not len(ia):
                    continue
                order = np.argsort(ia, kind="stable")
                ia, ib = ia[order], ib[order]
                got_a, got_b, got_j = [], [], []
                cuts = [0, *(np.flatnonzero(ia[1:] != ia[:-1]) + 1).tolist(), len(ia)]
                for p, q in zip(cuts, cuts[1:]):
                    i = ia[p]
                    own = flat[edge[i] : edge[i + 1]]
                    mark[own] = True
                    for s in range(p, q, stride):
                        other = ib[s : min(s + stride, q)]
                        if forest:
                            other = other[part[other] != part[i]]
                            if not len(other):
                                continue
                        take = size_[other]
                        ends = np.cumsum(take)
                        hit = mark[flat[np.arange(ends[-1]) - np.repeat(ends - take - edge[other], take)]]
                        overlap = np.add.reduceat(hit.astype(np.int32), ends - take)
                        jaccard = overlap / (total[i] + total[other] - overlap)
                        ok = overlap + np.maximum(rest[i], rest[other]) >= needed(total[i], total[other], threshold) if look else jaccard >= threshold
                        if forest and ok.any():
                            joined, once = np.unique(part[other[ok]], return_index=True)
                            ok = np.flatnonzero(ok)[once]
                            part[np.isin(part, joined)] = part[i]
                        got_a.append(np.full(len(other[ok]), i))
                        got_b.append(other[ok])
                        got_j.append(jaccard[ok])
                    mark[own] = False
                if not got_a:
                    continue
                ga, gb = np.concatenate(got_a), np.concatenate(got_b)
                yield pa.RecordBatch.from_arrays([pa.array(name[ga]), pa.array(name[gb]), pa.array(rep[ga]), pa.array(rep[gb]), pa.array(np.concatenate(got_j))], ["a", "b", "rep_a", "rep_b", "jaccard"])

    return run


def _joined(docs: DataFrame, threshold: float, n: int, tile: int, forest: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets of documents; their classes, each named by the number of one row of its least doc_id; verified pairs of classes."""
    sets = _stored(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_sets(n)), "doc_id long, id long, n int, sid long, check long, tokens binary"), "jaccard-sets")
    # Sets are equal if both hashes are.
    classes = _stored(sets.where("n > 0").groupBy("sid", "check").agg(F.min(F.struct("doc_id", "id", "n")).alias("least"), F.countDistinct("doc_id").alias("size")).select("sid", "check", "least.id", F.col("least.doc_id").alias("rep"), "least.n", "size"), "jaccard-classes")

    rows, grams_ = sets.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    drawn = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(1_000_000 * SAMPLE / max(rows, 1))
    late = often([r["tokens"] for r in sets.where(f"n between 1 and {SAMPLE_GRAMS}").where(drawn).select("tokens").collect()])
    spread = min(24, max(0, math.ceil(math.log2(max(grams_ or 1, 1) / POSTINGS)) - LOW_BITS))
    form = "bucket long, batch long, keys binary, docs binary, places binary"
    # Of equal sets one is listed: grams that only they share lead to no other.
    listed, shared = _maps(classes), []
    for k in range(ROUNDS):
        posts = sets.where("n > 0").select("id", "n", "tokens").mapInArrow(trimmed(_postings(late, threshold, spread, listed, k, ROUNDS)), f"{form}, levels binary")
        shared.append(_stored(posts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_shared(threshold)), "bucket long, batch long, use long, keys binary, docs binary, places binary"), f"jaccard-shared-{k}"))
    heads = classes.select(F.shiftright("id", 16).alias("batch"), F.lit(0).alias("kind"), F.expr("int(id & 65535)").alias("doc"), "n", *(F.lit(0).cast("long").alias(c) for c in ("bucket", "use")), *(F.lit(None).cast("binary").alias(c) for c in ("keys", "docs", "places")))
    both = reduce(DataFrame.unionByName, [heads, *(x.select("batch", F.lit(1).alias("kind"), F.lit(0).alias("doc"), F.lit(0).alias("n"), "bucket", "use", "keys", "docs", "places") for x in shared)])
    lists = _stored(both.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(trimmed(_listed(late)), "id long, n int, tokens binary, places binary, use binary, short binary"), "jaccard-prefixes")
    _delete(*shared)
    known = lists.drop("short").mapInArrow(trimmed(_remembered(spread)), f"{form}, sizes binary, left binary, before binary")
    meetings = known.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_meeting(threshold)), "a long, b long, weight long")
    pairs = _stored(meetings.groupBy("a", "b").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= MEETS).select("a", "b"), "jaccard-met")

    # What the prefixes have in common first: it leaves few pairs of unlike sets, and two bytes of each gram are enough.
    result = "a long, b long, rep_a long, rep_b long, jaccard double"
    first = placed = _placed(pairs, tile)
    looked = _stored(_work(_ends(placed).join(lists.select("id", "n", F.lit(0).cast("long").alias("rep"), F.col("short").alias("tokens")), "id"), placed).mapInArrow(trimmed(_verify(threshold, look=True)), result).select("a", "b"), "jaccard-looked")
    _delete(lists, pairs, first)
    placed = _placed(looked, tile)
    _delete(looked)
    # The bodies are what is large: only those in a pair are exchanged, and once, unless the list of their tiles is long.
    bodies, wanted = sets.select("id", "n", F.col("doc_id").alias("rep"), "tokens"), _stored(_ends(placed), "jaccard-ends")
    if wanted.count() <= HOMES:
        homes = defaultdict(list)
        for r in wanted.select("id", "tile").repartition(F.shiftright("id", 16)).sortWithinPartitions("id").mapInArrow(_homes, "batch long, docs binary, tiles binary").collect():
            homes[r["batch"]].append((bytes(r["docs"]), bytes(r["tiles"])))
        work = _work(bodies.mapInArrow(trimmed(_sent(dict(homes))), "tile long, id long, n int, rep long, tokens binary"), placed)
    else:
        work = _work(wanted.join(bodies.mapInArrow(_wanted(_maps(wanted)), "id long, n int, rep long, tokens binary"), "id"), placed)
    near = _stored(work.mapInArrow(trimmed(_verify(threshold, forest)), result), "jaccard-near")
    _delete(placed, wanted)
    return sets, classes, near


def _maps(rows: DataFrame) -> dict[int, bytes]:
    """One bit a row, in maps of 8 KB for 65,536 of them, tells which ids there are."""
    maps = rows.select("id").distinct().repartition(F.shiftright("id", 16)).sortWithinPartitions("id").mapInArrow(_bits, "batch long, bits binary").collect()
    return {r["batch"]: bytes(r["bits"]) for r in maps}


def _placed(pairs: DataFrame, tile: int) -> DataFrame:
    """(tile, a, b): pairs whose first sets have the same least neighbour share a tile; beyond `tile` sets it is joined part by part."""
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    lead = ends.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("lead"))
    led = pairs.join(lead.withColumnRenamed("id", "a"), "a")
    many = led.select("lead", F.col("a").alias("id")).union(led.select("lead", "b")).distinct().groupBy("lead").agg(F.ceil(F.count("*") / tile).alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    return _stored(led.join(many, "lead").select(F.xxhash64("lead", F.least(part("a"), part("b")), F.greatest(part("a"), part("b"))).alias("tile"), "a", "b"), "jaccard-pairs")


def _ends(placed: DataFrame) -> DataFrame:
    """(tile, id): the sets of each tile."""
    return placed.select("tile", F.col("a").alias("id")).union(placed.select("tile", F.col("b").alias("id"))).distinct()


def _work(bodies: DataFrame, placed: DataFrame) -> DataFrame:
    """Bodies (tile, id, n, rep, tokens) and pairs of each tile, as _verify takes them."""
    bodies = bodies.select("tile", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "rep", "n", "tokens")
    work = bodies.unionByName(placed.select("tile", F.lit(1).alias("kind"), "a", "b", F.lit(0).cast("long").alias("rep"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("tokens")))
    return work.repartition("tile").sortWithinPartitions("tile", "kind")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """stored(), after which the shuffle files of df go: the next steps read the table."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, None)
    conf.set(key, "true")
    try:
        return stored(df, name)
    finally:
        conf.unset(key) if was is None else conf.set(key, was)


def _delete(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step reads."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            jvm = table.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def jaccard_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, tile: int = TILE, forest: bool = False) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard), a < b: pairs of documents whose sets of word n-grams have at least this similarity.

    Words are runs of letters (with their marks) and numbers, by Unicode's categories and lower-cased; in scripts without
    spaces between words (Chinese, Japanese, Thai and others) each character is one. A text of fewer than n words has one gram, of all of them; a null or
    empty text, or one without words, has none and pairs with nothing. The result is factored: documents with equal sets
    give pairs of the least doc_id among them with each other one (jaccard 1), and only that one is paired with documents
    of other sets, as all of them would be; expand() gives the full list. Repeated rows are one document, and rows of one
    doc_id with different texts are several sets of it. Rows with a null doc_id can't be named and are left out. With
    forest the pairs are only so many as connect the same documents: their number doesn't grow with the square of a group.
    No pair is left out. Overlaps are counted over 40 bits of each gram's hash, so two unlike grams count as one in a million million times.
    """
    sets, classes, near = _joined(docs, threshold, n, tile, forest)
    same = sets.select("sid", "check", "doc_id").join(classes.select("sid", "check", "rep"), ["sid", "check"]).where("doc_id <> rep").select(F.col("rep").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    near = near.where("rep_a <> rep_b").select(F.least("rep_a", "rep_b").alias("doc_id_a"), F.greatest("rep_a", "rep_b").alias("doc_id_b"), "jaccard")
    return same.unionByName(near).groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard"))


def linked(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, tile: int = TILE) -> DataFrame:
    """(doc_id, class_id, copy_of, links), a row for each document: the join of jaccard_pairs without writing its pairs out.

    links is the number of other documents that reach the threshold with this one, copies included. copy_of is the least
    doc_id with an equal set, class_id the least one that the document is connected with by links. A document without words
    or without links has itself for both, and 0 links. Repeated rows are one document; rows of one doc_id with different
    texts are documents of their own, a row for each set. Rows with a null doc_id are left out.
    """
    sets, classes, near = _joined(docs, threshold, n, tile, False)
    size = classes.select("id", "size")
    ends = near.select("a", "b").union(near.select("b", "a")).toDF("id", "other")
    degree = ends.join(size.toDF("other", "size"), "other").groupBy("id").agg(F.sum("size").alias("others"))
    connected = groups(near.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))).toDF("id", "group").join(classes.select("id", "rep"), "id")
    least = connected.groupBy("group").agg(F.min("rep").alias("least"))
    connected = connected.join(least, "group").select("id", "least")
    each = classes.join(degree, "id", "left").join(connected, "id", "left").select("sid", "check", "rep", F.coalesce("least", "rep").alias("least"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("links"))
    rows = sets.select("doc_id", "sid", "check", "n").distinct().join(each, ["sid", "check"], "left")
    some = F.col("n") > 0
    return rows.select("doc_id", F.when(some, F.col("least")).otherwise(F.col("doc_id")).alias("class_id"), F.when(some, F.col("rep")).otherwise(F.col("doc_id")).alias("copy_of"), F.when(some, F.col("links")).otherwise(F.lit(0)).cast("long").alias("links"))


def expand(pairs: DataFrame) -> DataFrame:
    """All pairs that a factored result stands for. Their number grows with the square of the largest class."""
    equal = pairs.where("jaccard = 1").select(F.col("doc_id_a").alias("rep"), F.col("doc_id_b").alias("member"))
    members = equal.union(pairs.select("doc_id_a", "doc_id_a")).union(pairs.select("doc_id_b", "doc_id_b")).distinct()
    left, right = members.toDF("rep_a", "x"), members.toDF("rep_b", "y")
    over = pairs.join(left, pairs.doc_id_a == left.rep_a).join(right, pairs.doc_id_b == right.rep_b).select("x", "y", "jaccard")
    inside = left.join(members.toDF("rep_b", "y"), F.col("rep_a") == F.col("rep_b")).select("x", "y", F.lit(1.0).alias("jaccard"))
    return over.union(inside).where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "jaccard").groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard"))


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, group): the least doc_id that each paired document is connected with.

    Alternates large-star and small-star steps, each an aggregation and a join, until nothing changes; it needs about as many
    rounds as the logarithm of the longest chain. Documents without a pair have no row, nor has an empty table.
    """
    edges = stored(pairs.select(F.greatest("doc_id_a", "doc_id_b").alias("u"), F.least("doc_id_a", "doc_id_b").alias("v")).where("u <> v").distinct(), "groups-0")
    before = None
    for k in count():
        # Large star: neighbours above a node go to the least of its neighbourhood.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its lower neighbours go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, f"groups-{k + 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("group")).union(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("group"))).distinct()


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """docs without the documents that are in a group of jaccard_pairs and aren't its least doc_id, with docs' own columns.

    Repeated rows of a document that stays all stay, as do rows with a null doc_id and those without words.
    """
    key = fresh(docs, "__dropped")
    gone = groups(jaccard_pairs(docs, forest=True, **parameters)).where("doc_id <> group").select(F.col("doc_id").alias(key))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(key), "left_anti")
