"""From raw documents to token ids: quality, near copies, secrets, mixture, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and is written as Parquet and read again
for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from skeinlake.llm import credentials, cube, jaccard_rtree, nbsvm, sp_backend
from skeinlake.llm.common import exists, passing, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier fitted on labels doesn't reject. Rows with a null or empty text go; repeated rows are judged each."""
    return nbsvm.keep_quality(docs, read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near or exact copies. Rows with a null doc_id or without words stay."""
    return jaccard_rtree.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking credentials masked. Owners are counted over the raw table too, where there is one: by now copies, the evidence of an example, are gone. Null texts and ids pass as they are."""
    raw = read(spark, sf_dir, "documents") if exists(spark, f"{sf_dir}/documents.parquet") else None
    return credentials.mask_secrets(docs, raw)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample balanced in documents and tokens, sources in proportion to the target weights. Rows with a null doc_id can't be drawn and go."""
    return cube.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) of each document; nulls for a null text, no ids for an empty one."""
    return sp_backend.sentencepiece_encode(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("mixture", mixture), ("encode", encode)]

#: Fitting, connected components, sampling and tokenizing aren't expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the earlier ones' are written to the shared folder between stages, and deleted when the application ends."""
    docs = read(spark, sf_dir, "documents")
    base = passing(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        at = os.path.join(base, f"{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
