"""The ten operators over their whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from . import compression, credentials, crossparse, cube, hilbert, jaccard_rtree, nbsvm, sp_backend, syncmers, url_templates
from .common import read

QUERIES = {
    "op1_url_templates": lambda spark, d: url_templates.url_templates(read(spark, d, "pages"), read(spark, d, "labels")),
    "op2_compression_bands": lambda spark, d: compression.compression_bands(read(spark, d, "documents")),
    "op3_balanced_sample": lambda spark, d: cube.balanced_sample(read(spark, d, "documents")),
    "op4_nbsvm_quality": lambda spark, d: nbsvm.quality_scores(read(spark, d, "documents"), read(spark, d, "labels")),
    "op5_closed_syncmers": lambda spark, d: syncmers.closed_syncmers(read(spark, d, "documents")),
    "op6_hilbert_shards": lambda spark, d: hilbert.hilbert_shards(read(spark, d, "documents")),
    "op7_jaccard_join": lambda spark, d: jaccard_rtree.linked(read(spark, d, "documents")),
    "op8_sentencepiece": lambda spark, d: sp_backend.sentencepiece_encode(read(spark, d, "documents")),
    "op9_language_id": lambda spark, d: crossparse.identify_languages(read(spark, d, "documents")),
    "op10_secret_ownership": lambda spark, d: credentials.secret_ownership(read(spark, d, "documents")),
}

ORACLES = {
    "op1_url_templates": url_templates.ORACLE,
    "op6_hilbert_shards": hilbert.ORACLE,
    "op10_secret_ownership": credentials.ORACLE,
}
