"""Compression bands: zstandard ratios of whole documents and of fixed chunks, held against limits by length."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed, utf8

LEVEL, CHUNK = 3, 4096
#: (bytes below which the band holds, least and greatest ratio of the whole, least and greatest ratio of a chunk).
#: A ratio is raw bytes by compressed bytes. Ratios of prose grow with length, as matches have more to refer to, so each
#: band has limits of its own: below the least a text is close to random (base64 of noise has 4 / 3), above the greatest it
#: repeats itself. Below 256 bytes there is no least ratio: at 64 bytes zstandard stores prose and noise alike (64 / 73).
BANDS: tuple[tuple[float, float, float, float, float], ...] = (
    (64, 0.0, float("inf"), 0.0, float("inf")),
    (256, 0.0, 2.6, 0.0, float("inf")),
    (1024, 1.20, 3.4, 0.0, float("inf")),
    (4096, 1.40, 4.4, 0.0, float("inf")),
    (16384, 1.45, 5.2, 1.40, 6.5),
    (65536, 1.45, 6.0, 1.40, 6.5),
    (float("inf"), 1.45, 7.0, 1.40, 6.5),
)


def _ratios(level: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False).compress
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            view, n = memoryview(data), len(offsets) - 1
            whole, low, high, tail = (np.full(n, np.nan) for _ in range(4))
            for r in range(n):
                a, b = int(offsets[r]), int(offsets[r + 1])
                if b > a:
                    whole[r] = (b - a) / len(press(view[a:b]))
                    if b - a >= chunk:
                        each = [chunk / len(press(view[k : k + chunk])) for k in range(a, b - chunk + 1, chunk)]
                        low[r], high[r] = min(each), max(each)
                        if (b - a) % chunk:
                            tail[r] = chunk / len(press(view[b - chunk : b]))
            valid = np.asarray(batch.column(1).is_valid())
            nan = lambda x: pa.array(x, mask=np.isnan(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), mask=~valid), nan(whole), nan(low), nan(high), nan(tail)], ["doc_id", "n_bytes", "ratio", "chunk_low", "chunk_high", "chunk_last"])

    return run


def compression_bands(docs: DataFrame, bands: Sequence[tuple[float, float, float, float, float]] = BANDS, level: int = LEVEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, ratio, chunk_low, chunk_high, chunk_last, reason, keep) for each row of docs.

    ratio: UTF-8 bytes by compressed bytes of the whole text; chunk_low and chunk_high: the extremes over the full chunks
    from the text's start (null when there is none). chunk_last: that of the chunk that ends at the text's end, where the
    full ones leave a remainder (else null); it is judged as they are. reason is null for kept rows, else the first that
    holds of empty, repetitive, incompressible, repetitive chunk, incompressible chunk. A ratio at a limit is inside the band. Null text:
    null measures, reason empty; empty text: 0 bytes, reason empty. Null ids stay, repeated rows are each judged.
    """
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_ratios(level, chunk)), "doc_id long, n_bytes long, ratio double, chunk_low double, chunk_high double, chunk_last double")
    limit = [F.lit(bands[-1][k]) for k in range(1, 5)]
    for band in reversed(bands[:-1]):
        limit = [F.when(F.col("n_bytes") < band[0], F.lit(band[k])).otherwise(limit[k - 1]) for k in range(1, 5)]
    reason = (
        F.when(F.coalesce(F.col("n_bytes"), F.lit(0)) == 0, "empty")
        .when(F.col("ratio") > limit[1], "repetitive")
        .when(F.col("ratio") < limit[0], "incompressible")
        .when(F.greatest("chunk_high", "chunk_last") > limit[3], "repetitive chunk")
        .when(F.least("chunk_low", "chunk_last") < limit[2], "incompressible chunk")
    )
    return measured.withColumn("reason", reason).withColumn("keep", F.col("reason").isNull())
