"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, exact_dedup, langid, licenses, mixing, oracles, secrets, sharding, simhash, suffix_dedup, topk

VOCABULARY = "byte_bpe_50k.tiktoken"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    told = langid.predict(docs, langid.fit(docs), ["doc_id"])
    return told.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("lang_pred_").alias("lang_pred"), F.col("score_").alias("score"), F.col("rejected_").alias("rejected"), F.col("entropy_").alias("bits_per_symbol"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixing.add_slots(rows.withColumn("text", F.xxhash64("text"))).select("doc_id", "source", F.col("stratum_").alias("stratum"), F.col("block_").alias("block"), F.col("slot_").alias("slot"), F.col("in_block_").alias("in_block"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(documents(spark, sf_dir))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(documents(spark, sf_dir))


def queries() -> dict:
    return {"op1_langid": op1_langid, "op2_suffix_dedup": op2_suffix_dedup, "op3_sharding": op3_sharding, "op4_bpe": op4_bpe, "op5_secrets": op5_secrets, "op6_licenses": op6_licenses, "op7_top_k": op7_top_k, "op8_simhash": op8_simhash, "op9_exact_dedup": op9_exact_dedup, "op10_mixing": op10_mixing}


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
