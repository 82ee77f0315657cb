"""SentencePiece models on the tokenizers library.

The model protobuf is parsed here (wire format, no generated classes), and its parts are rebuilt: the normaliser
(precompiled character map, removal of extra spaces, dummy prefix, metaspace marker), the pieces with their scores (a
unigram lattice, or for a BPE model the merges that the scores imply), and byte fallback. Text is encoded in batches,
with the library's own threads.

Pieces never cross from a character other than the marker to a marker (checked when a model is loaded), so a text can be
cut before each run of markers without changing its encoding. That keeps words short and lets the library cache them.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passes, trimmed, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Encoded at load time by both libraries, so that a wrong rebuild fails at once.
PROBES = ["", " ", "a", "Hello, world.", "  two  spaces ", "tab\tand\nline\n\n", "héllo Über ñandú", "你好 \U0001f600 �", "x" * 70, "▁ mark ▁▁", "a|b | c%%% D!! 123,456"]


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(raw):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            value: int | bytes = varint()
        else:
            size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            value = raw[i : i + size]
            i += size
        yield tag >> 3, value


def parse_model(raw: bytes) -> Model:
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.remove_extra, model.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    return model


def build(model: Model):
    """A tokenizers.Tokenizer that encodes as the model does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
    if model.kind == UNIGRAM:
        # Control and unused pieces are never matched in text; a floor below every score keeps them out of the best path.
        low = min((s for _, s, _ in model.pieces), default=0.0) - 1e6
        core = models.Unigram([(p, s if kind in (NORMAL, USER) else low) for p, s, kind in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        merges = []
        for p, score, kind in model.pieces:
            if kind == NORMAL and len(p) > 1:
                merges += [(-score, ids[p], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        core = models.BPE(vocab=ids, merges=[(a, b) for _, _, a, b in sorted(merges)], unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER)):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]*"), "isolated")
    if user := [AddedToken(p, normalized=True) for p, _, kind in model.pieces if kind == USER]:
        tokenizer.add_tokens(user)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


def model_bytes(path: str) -> bytes:
    """A model file, read where the job is put together: the executors get its bytes with the job and need no such file."""
    with open(path, "rb") as f:
        return f.read()


@cache
def load(raw: bytes):
    """The rebuilt tokenizer of a model; it is held against the original library on PROBES, and a difference raises."""
    import sentencepiece

    tokenizer = build(parse_model(raw))
    original = sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text, want in zip(PROBES, original.encode(PROBES, num_threads=1)):
        got = tokenizer.encode(text, add_special_tokens=False).ids
        if got != want:
            raise ValueError(f"the rebuilt tokenizer differs from the model on {text!r}: {got} for {want}")
    return tokenizer


_TABLE = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n, by 64-bit arithmetic."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Encoder:
    """Encodes whole texts by their chunks: a run of markers with what follows it, or a line feed. A chunk seen before isn't encoded again.

    Texts are cut, and equal chunks found, over the bytes of many texts at once; only chunks that are new go to the library,
    many in a call. `most` chunks are remembered, then memory starts anew; that changes speed, not results.
    """

    def __init__(self, path: str | bytes, most: int = 200_000):
        from tokenizers import Tokenizer, pre_tokenizers

        raw = path if isinstance(path, bytes) else model_bytes(path)
        self.model = parse_model(raw)
        whole = load(raw)
        self.bare = Tokenizer.from_str(whole.to_str())
        self.bare.normalizer = None
        free = [p for p, _, kind in self.model.pieces if kind in (NORMAL, USER)]
        self.cut = not any(MARK in p.lstrip(MARK) for p in free) and self.model.escape and not any(kind == USER for _, _, kind in self.model.pieces)
        lines = self.model.byte_fallback and not any("\n" in p for p in free)
        self.line = next(i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE and p == "<0x0A>") if lines else None
        if lines:
            self.bare.pre_tokenizer = pre_tokenizers.Split("\n", "isolated")
        shown = (lambda p: p.replace(MARK, " ")) if self.model.escape else (lambda p: p)
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (UNKNOWN, CONTROL) else shown(p).encode() for p, _, kind in self.model.pieces]
        self.plain = not self.model.charsmap and not self.model.remove_extra and self.model.escape
        # Of the whole tokenizer only the normaliser is needed from here on, and that not always: a worker keeps one copy of the pieces.
        self.whole = None if self.plain else whole
        load.cache_clear()
        self.prefix = MARK if self.model.dummy_prefix else ""
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.begin, self.size, self.good = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        if self.cut and self.line is not None:
            # A line feed is known from the start, so that no chunk which is learnt holds one.
            self.known[b"\n"] = 0
            self.pool, self.begin, self.size, self.good = np.array([self.line], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64), np.ones(1, bool)

    def normal(self, text: str) -> str:
        """What the library's normaliser makes of a text."""
        return self.whole.normalizer.normalize_str(text) if text and self.whole.normalizer else text

    def learn(self, chunks: list[bytes]) -> None:
        """Encodes chunks. Where a line feed is a token of its own, many chunks go to the library as the lines of one string: a call for each costs more than its encoding."""
        spaced = (lambda t: t.replace(" ", MARK)) if self.model.escape else (lambda t: t)
        if self.line is None or not self.cut:
            rows = [np.array(e.ids, np.int32) for e in self.bare.encode_batch_fast([spaced(c.decode()) for c in chunks], add_special_tokens=False)]
            size = np.array([len(r) for r in rows], np.int64)
            ids = np.concatenate(rows)
            begin = np.cumsum(size) - size
        else:
            blocks = [spaced(b"\n".join(chunks[k : k + 500]).decode()) for k in range(0, len(chunks), 500)]
            rows = [part for e in self.bare.encode_batch_fast(blocks, add_special_tokens=False) for part in (np.array(e.ids, np.int32), np.array([self.line], np.int32))]
            ids = np.concatenate(rows)
            ends = np.flatnonzero(ids == self.line)
            begin = np.concatenate([[0], ends[:-1] + 1])
            size = ends - begin
        self.begin = np.concatenate([self.begin, len(self.pool) + begin])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, ids])
        self.good = np.concatenate([self.good, self.decodes(chunks, ids, begin, size)])

    def decodes(self, chunks: list[bytes], ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the pieces of each chunk spell it."""
        widths = np.array([len(x) for x in self.bytes], np.int64)
        cost = np.concatenate([[0], np.cumsum(widths[ids])])
        good = cost[begin + size] - cost[begin] == np.array([len(c) for c in chunks])
        spell = lambda k: b"".join([self.bytes[x] for x in ids[begin[k] : begin[k] + size[k]].tolist()])
        rest = np.flatnonzero(good)
        inside = ids[np.arange(int(size[rest].sum())) + np.repeat(begin[rest] - np.cumsum(size[rest]) + size[rest], size[rest])]
        if b"".join([self.bytes[x] for x in inside.tolist()]) != b"".join([chunks[k] for k in rest.tolist()]):
            good[rest] = [spell(k) == chunks[k] for k in rest.tolist()]
        return good

    def starts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where chunks begin in texts that begin there: a marker after none, a line feed, what follows one."""
        if not self.cut:
            return begins
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        if self.line is not None:
            line = data == 10
            first |= line
            first[1:] |= line[:-1]
        first[begins] = True
        return np.flatnonzero(first)

    def which(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each chunk among the known ones, new ones learnt. Equal hashes are held against the bytes themselves."""
        n = len(data)
        ends = np.append(starts[1:], n)
        room = 1 << max(20, n.bit_length())
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * _powers(_STEP, room)[:n], out=sums[1:])
        width = ends - starts
        hashes = (sums[ends] - sums[starts]) * _powers(_BACK, room)[starts] + width.astype(np.uint64)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        twin = first[inverse]
        same = bool((width == width[twin]).all()) and bool((data == data[np.arange(n) + np.repeat(starts[twin] - starts, width)]).all())
        if not same:
            first, inverse = np.arange(len(starts)), np.arange(len(starts))
        text, known, new = data.tobytes(), self.known, []
        number = np.empty(len(first), np.int64)
        for k, (a, b) in enumerate(zip(starts[first].tolist(), ends[first].tolist())):
            chunk = text[a:b]
            at = known.get(chunk)
            if at is None:
                at = known[chunk] = len(known)
                new.append(chunk)
            number[k] = at
        if new:
            self.learn(new)
        return number[inverse]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """(ids of all texts in a row, count of each text, whether each decodes to itself)."""
        return self.encoded([t.encode() for t in texts])

    def encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """As a call, for UTF-8 bytes."""
        mark = MARK.encode()
        # A marker takes one byte from here on: that of a space.
        if self.plain:
            normal = [(b" " if self.prefix else b"") + t.replace(mark, b" ") if t else t for t in texts]
            same = [mark not in t for t in texts]
        else:
            normal = [self.normal(t.decode()).encode() for t in texts]
            same = [n.replace(mark, b" ")[len(self.prefix) if n else 0 :] == t for n, t in zip(normal, texts)]
            if self.model.escape:
                normal = [n.replace(mark, b" ") for n in normal]
        begins = np.cumsum([0, *map(len, normal)])
        data = np.frombuffer(b"".join(normal), np.uint8)
        full = begins[:-1][begins[1:] > begins[:-1]]
        starts = self.starts(data, full)
        ids, sizes, bad = [], np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
        # Far longer texts than a pass are taken piece by piece, cut between chunks.
        cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), 1 << 20)), len(starts))).tolist() if len(starts) else []
        for p, q in zip([0, *cuts[1:-1]], cuts[1:]):
            if len(self.known) > self.most:
                self.forget()
            a, b = int(starts[p]), int(starts[q]) if q < len(starts) else len(data)
            which = self.which(data[a:b], starts[p:q] - a)
            size = self.size[which]
            ends = np.cumsum(size)
            ids.append(self.pool[np.arange(int(ends[-1])) - np.repeat(ends - size - self.begin[which], size)])
            sizes[p:q], bad[p:q] = size, ~self.good[which]
        edge = np.searchsorted(starts, begins)
        total, wrong = np.concatenate([[0], np.cumsum(sizes)])[edge], np.concatenate([[0], np.cumsum(bad)])[edge]
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.diff(total), [ok and not w for ok, w in zip(same, np.diff(wrong).tolist())]


def _encode(raw: bytes, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        encoder = Encoder(raw)
        for batch in batches:
            texts = batch.column(1)
            valid = np.asarray(texts.is_valid())
            data, offsets = utf8(texts)
            view = memoryview(data)
            for i, j in passes(offsets, 1_000_000):
                ids, size, same = encoder.encoded([view[a:b].tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist())])
                ok = valid[i:j]
                begins = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(begins), pa.array(ids), mask=pa.array(~ok))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array(size.astype(np.int32), mask=~ok), pa.array(np.array(same, bool), mask=~ok)], ["doc_id", "token_ids", "n_tokens", "round_trip"])

    return run


def sentencepiece_encode(docs: DataFrame, model_path: str = MODEL, threads: int = 2) -> DataFrame:
    """One row (doc_id, token_ids, n_tokens, round_trip) for each row of docs.

    token_ids are those that the SentencePiece model gives for the whole text, without begin or end marks; round_trip says
    whether decoding them gives the text back. Null text: null in the three columns. Empty text: no ids, 0, true. A null
    doc_id stays null; repeated rows are encoded each. Other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_encode(model_bytes(model_path), threads)), "doc_id long, token_ids array<int>, n_tokens int, round_trip boolean")


def _decode(raw: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(raw)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            back = tokenizer.decode_batch([r or [] for r in rows], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if r is None else t for r, t in zip(rows, back)], pa.string())], ["doc_id", "text"])

    return run


def sentencepiece_decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, token_ids). Null ids give null, no ids the empty text."""
    return encoded.select("doc_id", "token_ids").mapInArrow(trimmed(_decode(model_bytes(model_path))), "doc_id long, text string")
