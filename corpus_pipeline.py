"""The corpus pipeline: language ID, near duplicates, mixing, BPE.

STAGES holds (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents. No stage can be expressed in SQL, so ORACLE_SQL is None and
tests compare the pipeline with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexigrain.llm import bpe, common, langid, mixing, neardup

ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return langid.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar texts stays."""
    return neardup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out by their rates."""
    return mixing.mix(docs, common.table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded text of each document left."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", identify), ("n-gram Jaccard join", deduplicate), ("mixing", mix), ("BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table; what each returns is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
