"""Language by cross-parsing: a text is cut, greedily, into the longest phrases that occur in a language's labelled text.

The suffix automaton of each language's text gives the longest matches. Walking it from the left and starting anew where a
match ends is a finite-state machine over (state, character), so its table is laid out flat, with the number of phrases that
a step ends in the low bits, and a batch of texts takes each step together in all languages. Each language has the alphabet
of its own text; a letter outside of it is a phrase by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import passes, trimmed, utf8

#: The bound of the labelled sample: characters of text for each language, from at most ROWS rows, whole texts in the order of a hash of doc_id. Of a language that has only longer ones it is the shortest.
CHARS, ROWS = 30_000, 200
#: A language with more symbols than this (every letter of its labelled text is one) has its transitions as sorted keys in place of a flat table.
FLAT = 127
#: Symbols of a text that are walked in a row; a longer text's segments are walked side by side.
SEGMENT = 4096
SPACE = 1


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence of symbols; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """Phrase counts of texts against several languages' texts at once."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        text = np.frombuffer("".join(samples[k] for k in self.names).lower().encode("utf-32-le"), np.uint32)
        kinds = np.unique(text[letters()[text]])
        self.symbol = np.where(letters(), 0, SPACE).astype(np.uint8 if len(kinds) < 254 else np.int32)
        self.symbol[kinds] = np.arange(2, len(kinds) + 2)
        tables, local, base, self.roots, self.flat, self.keyed = [], [], 0, [], [], []
        for k, name in enumerate(self.names):
            raw = samples[name].lower().encode("utf-8")
            codes = self.symbols(np.frombuffer(raw, np.uint8), np.array([0, len(raw.decode())]))[0]
            own = np.unique(codes[codes > SPACE])
            mine = np.zeros(len(kinds) + 2, np.int32)
            mine[SPACE], mine[own] = SPACE, np.arange(2, len(own) + 2)
            states, width = automaton(mine[codes]), len(own) + 2
            at_root = np.array([states[0].get(c, 0) for c in range(width)])
            if width > FLAT:
                moves = np.array(sorted((s * width + c, to) for s, m in enumerate(states) for c, to in m.items()), np.int64).reshape(-1, 2)
                self.keyed.append((k, mine, width, np.ascontiguousarray(moves[:, 0]), np.ascontiguousarray(moves[:, 1]), at_root))
                continue
            table = np.zeros((len(states), width), np.int64)
            # No transition: the phrase ends (1) and the character begins the next one, or is a phrase by itself (1 more).
            table[:] = (base + at_root * width) * 4 + np.where(at_root > 0, 1, 2)
            table[0] = (base + at_root * width) * 4 + np.where(at_root > 0, 0, 1)
            for s, moves in enumerate(states):
                for c, to in moves.items():
                    table[s, c] = (base + to * width) * 4
            self.flat.append(k)
            self.roots.append(base)
            tables.append(table.ravel())
            local.append(mine)
            base += table.size
        # The walk adds the symbol to a state's place, so places and not states are kept.
        self.kind = np.int32 if base < 1 << 29 else np.int64
        self.table = np.concatenate(tables).astype(self.kind) if tables else np.zeros(0, self.kind)
        self.local = np.array(local, np.int32).reshape(-1, len(kinds) + 2)

    def __call__(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows: slices of codes, symbols) in each language.

        Segments of a text are walked side by side, each as if the text began there; then, from segment to segment, what
        really comes in is walked along as well until both are in one state, from where on they don't differ.
        """
        size = np.diff(begins)
        pieces = np.maximum(1, -(-size // SEGMENT))
        first = np.cumsum(pieces) - pieces
        of = np.repeat(np.arange(len(size)), pieces)
        start = begins[:-1][of] + (np.arange(len(of)) - first[of]) * SEGMENT
        left = np.minimum(start + SEGMENT, begins[1:][of]) - start
        root = np.zeros((len(self.names), 1), np.int64)
        root[self.flat, 0] = self.roots
        at, count = self.walk(codes, start, left, np.repeat(root, len(of), 1))
        for k in range(1, int(pieces.max()) if len(pieces) else 0):
            seg = first[pieces > k] + k
            true, fresh, t, width = at[:, seg - 1], np.repeat(root, len(seg), 1), 0, 64
            while (true != fresh).any() and t < left[seg].max():
                ahead = np.clip(left[seg] - t, 0, width)
                true, more = self.walk(codes, start[seg] + t, ahead, true)
                fresh, less = self.walk(codes, start[seg] + t, ahead, fresh)
                count[:, seg] += more - less
                t, width = t + width, 2 * width
            at[:, seg] = np.where(true != fresh, true, at[:, seg])
        if not len(size):
            return np.empty((0, len(self.names)), np.int32)
        return (np.add.reduceat(count, first, 1) + (at[:, first + pieces - 1] != root)).T.astype(np.int32)

    def walk(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States (rows: languages) after so many symbols from states `at`, and the phrases that ended on the way."""
        order = np.argsort(-size, kind="stable")
        start, left = begin[order], size[order]
        n, flat = len(size), len(self.flat)
        others = [k for k, *_ in self.keyed]
        state, keyed = at[self.flat][:, order].astype(self.kind), at[others][:, order]
        count, keyed_count = np.zeros((flat, n), np.int32), np.zeros((len(self.keyed), n), np.int32)
        table, t = self.table, 0
        longest = int(left[0]) if n else 0
        while t < longest:
            m = int(np.searchsorted(-left, -t, "left"))
            # Over a block in which the same texts last, places are laid out once.
            until = min(int(left[m - 1]), t + max(1, 1_000_000 // (m * max(flat, 1))))
            block = codes[start[:m] + np.arange(t, until)[:, None]]
            if flat:
                s, c = state[:, :m].copy(), count[:, :m].copy()
                for row in self.local.take(block, 1).swapaxes(0, 1):
                    s += row
                    s = table.take(s)
                    c += s & 3
                    s >>= 2
                state[:, :m], count[:, :m] = s, c
            for k, (_, mine, width, keys, to, at_root) in enumerate(self.keyed):
                s, c = keyed[k, :m], keyed_count[k, :m]
                for row in mine[block]:
                    place = s * width + row
                    i = np.minimum(np.searchsorted(keys, place), len(keys) - 1)
                    goes, begun = keys[i] == place, at_root[row]
                    c += np.where(goes, 0, np.where(begun > 0, 1, 2) - (s == 0))
                    s = np.where(goes, to[i], begun)
                keyed[k, :m] = s
            t = until
        out, total = np.empty((len(self.names), n), np.int64), np.empty((len(self.names), n), np.int64)
        for rows, ends, counts in ((self.flat, state, count), (others, keyed, keyed_count)):
            out[np.array(rows, int)[:, None], order], total[np.array(rows, int)[:, None], order] = ends, counts
        return out, total

    def symbols(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of UTF-8 texts and where each text's begin. Runs of what isn't a letter become one space: digits and signs tell no language."""
        codes = self.symbol[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
        keep[begins[:-1][begins[:-1] < len(codes)]] = True
        return codes[keep], np.concatenate([[0], np.cumsum(keep)])[begins]


def samples(docs: DataFrame, chars: int = CHARS, rows: int = ROWS) -> dict[str, str]:
    """Labelled text by language: whole texts, in the order of a hash of doc_id, as long as they fit into the bound; at least one, the shortest, if none fits."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.trim("lang").alias("lang"), F.length("text").alias("size")).where("doc_id is not null and lang <> '' and size > 0")
    above = F.col("size") > chars
    w = Window.partitionBy("lang").orderBy(above, F.when(above, F.col("size")), F.xxhash64("doc_id"), "doc_id", "size")
    ranked = known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= rows).where(~above | (F.col("rank") == 1))
    running = ranked.withColumn("before", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1))).where((F.coalesce("before", F.lit(0)) < chars))
    # At most `rows` ids of each language, whatever the corpus.
    ids = running.select("doc_id", F.col("lang").alias("label"), "rank", F.col("size").alias("chosen"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.trim("lang").alias("lang"), "text").join(F.broadcast(ids), "doc_id").where("lang = label and length(text) = chosen").select("label", "rank", "text").distinct().collect()
    out: dict[str, str] = {}
    for label, _, text in sorted(found):
        if len(out.get(label, "")) + len(text) <= chars or label not in out:
            out[label] = f"{out[label]}\0{text}" if label in out else text
    return out


@lru_cache(maxsize=1)
def parser_of(samples: tuple[tuple[str, str], ...]) -> Parser:
    """The parser of some samples. A worker keeps the last one: it is the same in all tasks of a job."""
    return Parser(dict(samples))


def _identify(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(shared.value)
        names = np.array([*parser.names, ""], object)
        for batch in batches:
            texts = pc.utf8_lower(batch.column(1))
            _, offsets = utf8(texts)
            for i, j in passes(offsets, 8_000_000):
                part = texts.slice(i, j - i)
                size = pc.fill_null(pc.utf8_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                data, off = utf8(part)
                codes, begins = parser.symbols(data[off[0] : off[-1]], np.concatenate([[0], np.cumsum(size)]))
                phrases, size = parser(codes, begins), np.diff(begins)
                best = phrases.argmin(1) if len(parser.names) else np.zeros(len(size), int)
                ordered = np.sort(phrases, 1) if len(parser.names) else np.zeros((len(size), 1))
                ok = (size > 0) & (len(parser.names) > 0)
                best = np.where(ok, best, len(parser.names))
                per = np.where(ok, ordered[:, 0] / np.maximum(size, 1), np.nan)
                margin = np.where(ok & (ordered.shape[1] > 1), (ordered[:, min(1, ordered.shape[1] - 1)] - ordered[:, 0]) / np.maximum(size, 1), np.nan)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x or None for x in names[best]], pa.string()), pa.array(ordered[:, 0].astype(np.int64), mask=~ok), pa.array(per, mask=np.isnan(per)), pa.array(margin, mask=np.isnan(margin))], ["doc_id", "language", "phrases", "phrases_per_char", "margin"])

    return run


def identify_languages(docs: DataFrame, labelled: DataFrame | None = None, chars: int = CHARS, rows: int = ROWS) -> DataFrame:
    """(doc_id, language, phrases, phrases_per_char, margin) for each row of docs.

    language: the one in whose labelled text the whole lower-cased text, with runs of non-letters as one space, parses into fewest
    phrases per character; of equal
    ones the first by name. margin: by how many phrases per character the next language is behind (null with one language).
    labelled (doc_id, lang, text) is docs where it isn't given; rows without a label or text aren't sampled. Null and
    empty texts, or no labelled text at all: null in the four columns. Null ids stay, repeated rows are each judged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(samples(labelled if labelled is not None else docs, chars, rows).items())))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_identify(shared)), "doc_id long, language string, phrases long, phrases_per_char double, margin double")
