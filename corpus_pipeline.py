"""Corpus pipeline over the documents table, one operator per stage.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet to
the shared folder and read again as the next stage's documents.  All but the
last return the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ember.llm import bagminhash, bpe, mixing, ordinal
from ember.llm.common import stored, table

#: No SQL form: classifier, signatures and merges; tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled sample, keeps."""
    model = ordinal.train(docs, table(spark, sf_dir, "labels"))
    return ordinal.select_documents(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class (five words, similarity 0.8)."""
    return bagminhash.keep_one(docs, threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixing.repeat_documents(docs, weights=(3, 1, 2), share=1.5, max_epochs=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, one row per repetition."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
