"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, first_in_row, passes, trimmed, utf8

#: Features are hashed byte n-grams of these orders; case and punctuation count, as they carry much of a page's quality.
ORDERS, BITS = (3, 4), 18
#: The bound of the labelled sample: at most so many rows of each class, those with the least hash of their doc_id.
SAMPLE_PER_CLASS = 2000
#: Of the sample one row in HELD_OUT isn't fitted on; the threshold is the score that KEEP_GOOD of its good rows reach, 0 at most.
HELD_OUT, KEEP_GOOD = 5, 0.99
SMOOTH, COST, EPOCHS, TOLERANCE = 1.0, 10.0, 30, 0.01


def features(data: np.ndarray, offsets: np.ndarray, orders: Sequence[int] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each text, each once, and where those of each text begin. A text far beyond a pass is taken piece by piece, so that memory doesn't follow its length."""
    a, size = int(offsets[0]), np.diff(offsets)
    if len(size) == 1 and size[0] > 2 * CHUNK_BYTES:
        seen, end = np.zeros(1 << bits, bool), int(offsets[-1])
        for b in range(a, end, CHUNK_BYTES):
            seen[features(data, np.array([b, min(b + CHUNK_BYTES + max(orders) - 1, end)]), orders, bits)[0]] = True
        values = np.flatnonzero(seen).astype(np.int32)
        return values, np.array([0, len(values)])
    text = data[a : int(offsets[-1])].astype(np.uint32)
    begins = offsets - a
    counts = [np.maximum(size - n + 1, 0) for n in orders]
    edge = np.concatenate([[0], np.cumsum(sum(counts))]).astype(np.int64)
    out = np.empty(int(edge[-1]), np.int32)
    done = np.zeros(len(size), np.int64)
    for n, count in zip(orders, counts):
        total = int(count.sum())
        if not total:
            continue
        h = np.zeros(max(len(text) - n + 1, 0), np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + text[k : k + len(h)]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h = ((h ^ (h >> np.uint32(13))) * np.uint32(0x297A2D39) + np.uint32(n)) >> np.uint32(32 - bits)
        before = np.cumsum(count) - count
        within = np.arange(total) - np.repeat(before, count)
        out[np.repeat(edge[:-1] + done, count) + within] = h[np.repeat(begins[:-1], count) + within]
        done += count
    keep = first_in_row(out, edge)
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[edge]


@dataclass
class Model:
    weights: np.ndarray
    ratios: np.ndarray
    #: The score of a text without features: 0, or of the only class there is.
    empty: float = 0.0
    threshold: float = 0.0

    def score(self, values: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Margins. There is no bias: a text of unknown n-grams is near 0 whatever its length, so short texts aren't judged by their lack of evidence."""
        sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x[values], dtype=np.float64)])[begins])
        norm = np.sqrt(np.maximum(sums(self.ratios**2), 1e-12))
        return sums(self.weights * self.ratios) / norm + self.empty


def fit(rows: Sequence[np.ndarray], labels: Sequence[int], bits: int = BITS, smooth: float = SMOOTH, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """L1-loss linear SVM by dual coordinate descent over unit-length rows of log-count ratios; classes weigh alike."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    size = 1 << bits
    if not len(y) or len(set(y)) < 2:
        return Model(np.zeros(size), np.zeros(size), float(np.sign(y.sum())) if len(y) else 1.0)
    counts = {s: np.full(size, smooth) for s in (1.0, -1.0)}
    for row, s in zip(rows, y):
        counts[s][row] += 1
    r = np.log(counts[1.0] / (smooth * 2 + (y > 0).sum())) - np.log(counts[-1.0] / (smooth * 2 + (y < 0).sum()))
    x = [r[row] / max(np.sqrt((r[row] ** 2).sum()), 1e-6) for row in rows]
    upper = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    w, alpha, rng = np.zeros(size), np.zeros(len(y)), np.random.default_rng(seed)
    usable = np.array([v @ v > 0 for v in x])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(np.flatnonzero(usable)):
            row, v = rows[i], x[i]
            g = y[i] * (w[row] @ v) - 1
            pg = min(g, 0) if alpha[i] == 0 else max(g, 0) if alpha[i] == upper[i] else g
            worst = max(worst, abs(pg))
            if pg:
                old = alpha[i]
                alpha[i] = min(max(old - g / (v @ v), 0.0), upper[i])
                w[row] += (alpha[i] - old) * y[i] * v
        if worst < TOLERANCE:
            break
    return Model(w, r)


def _featurise(orders, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in passes(offsets):
                values, begins = features(data, offsets[i : j + 1], orders, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values)), batch.column(2).slice(i, j - i)], ["doc_id", "features", "quality"])

    return run


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, orders: Sequence[int] = ORDERS, bits: int = BITS) -> Model:
    """The model of a bounded sample of labelled rows. A doc_id with both labels, or a null in either column, isn't used."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("quality > 0").orderBy(*order).limit(per_class).unionByName(known.where("quality <= 0").orderBy(*order).limit(per_class))
    # The sample is bounded by a parameter, whatever the corpus, so its ids may be broadcast.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = found.select("doc_id", "text", "quality").mapInArrow(trimmed(_featurise(orders, bits)), "doc_id long, features array<int>, quality int").toArrow()
    by_id = {}
    for i, r, q in zip(rows["doc_id"].to_pylist(), rows["features"], rows["quality"].to_pylist()):
        v = r.values.to_numpy(zero_copy_only=False)
        if i not in by_id or (len(v), v.sum()) > (len(by_id[i][0]), by_id[i][0].sum()):
            by_id[i] = (v, q)
    ids = sorted(by_id)
    split = {q: [i for i in ids if (by_id[i][1] > 0) == q] for q in (True, False)}
    held = split[True][::HELD_OUT] if min(map(len, split.values())) >= 2 * HELD_OUT else []
    fitted = [i for i in ids if i not in {*held, *(split[False][::HELD_OUT] if held else [])}]
    model = fit([by_id[i][0] for i in fitted], [by_id[i][1] for i in fitted], bits)
    if held:
        score = model.score(np.concatenate([by_id[i][0] for i in held]), np.concatenate([[0], np.cumsum([len(by_id[i][0]) for i in held])]))
        model.threshold = min(0.0, float(np.quantile(score, 1 - KEEP_GOOD)))
    return model


def _score(shared, orders, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            score = np.concatenate([np.zeros(0), *(model.score(*features(data, offsets[i : j + 1], orders, bits)) for i, j in passes(offsets))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= shared.value.threshold) & (np.diff(offsets) > 0))], ["doc_id", "score", "keep"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, orders: Sequence[int] = ORDERS, bits: int = BITS) -> DataFrame:
    """(doc_id, score, keep) for each row of docs: the margin of the model fitted on labels, and whether it reaches the model's threshold.

    Null and empty texts: score 0, not kept. Null ids stay; repeated rows are scored each. Without
    labelled rows of both classes every text has the same score: kept, unless all labels are bad.
    """
    model = train(docs, labels, per_class, orders, bits)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_score(shared, orders, bits)), "doc_id long, score double, keep boolean")


def keep_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, orders: Sequence[int] = ORDERS, bits: int = BITS) -> DataFrame:
    """The rows of docs that quality_scores keeps, with docs' own columns whatever they are. Nothing is shuffled."""
    model = train(docs, labels, per_class, orders, bits)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            score = np.concatenate([np.zeros(0), *(shared.value.score(*features(data, offsets[i : j + 1], orders, bits)) for i, j in passes(offsets))])
            yield batch.filter(pa.array((score >= shared.value.threshold) & (np.diff(offsets) > 0)))

    return docs.mapInArrow(trimmed(run), docs.schema)
