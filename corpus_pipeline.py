"""The corpus pipeline: five stages, each an operator over all that the stage before it kept.

Every stage's result is written as Parquet in the shared working folder and read again as the next
one's documents. The first four return the columns of ``documents``; the last returns what the written
token shards hold of each document.

Every stage takes null, empty and very long texts, null and repeated ids, repeated rows, empty tables and
further columns, whatever their names; columns come back as they are. What a stage makes of them:
a null text, or one without a letter, is rejected with its language; so no later stage of ``run`` sees
one, though each takes it: as a near-duplicate of other empty texts, as clean, as a row of size 0 that
the mix takes as often as its place says, and as the end id alone. Ties fall to the smallest id, then to
the text's hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assay.llm import decontam, langid, mixing, simhash, wavelet
from assay.storage import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; what the model rejects goes."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs, one_an_id=False)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet-matrix shards; a row for each document as read from the files."""
    return wavelet.token_shards(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("mixture", mixture), ("token_shards", token_shards)]

#: The stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
