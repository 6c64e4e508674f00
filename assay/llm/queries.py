"""Queries of the corpus operators, and SQL for those that SQL can express.

Each query hands its whole tables to its operator, whose docstring says what null ids and texts, empty
and very long texts, ties, repeated rows, empty tables and further columns give; a query adds nothing to
that but the digest columns of ``op1_line_dedup`` (both null for a null text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontam, langid, linededup, mixing, negatives, oracles, packing, pitman_yor, quality, simhash, tokens, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = linededup.dedup_lines(docs)
    return found.select("doc_id", "n_chunks", "n_removed_chunks", "n_removed_lines", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pitman_yor.score(table(spark, sf_dir, "documents"), order=2)
    return found.withColumnsRenamed({"score": "closed_score", "log10_prob": "score"})


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_shards(table(spark, sf_dir, "documents"))


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op1_line_dedup": oracles.LINE_DEDUP, "op6_source_mix": oracles.SOURCE_MIX, "op10_perspectives": oracles.PERSPECTIVES, "op11_hard_negatives": oracles.HARD_NEGATIVES, "op12_filter_audit": oracles.FILTER_AUDIT, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql}
