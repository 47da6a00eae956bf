"""The registered queries of the subpackage and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import block_search, merge_dropout, mixing, quality_rules, quotation, sanitise, simhash, suffix_dedup, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.reply_ordered(table(spark, sf_dir, "conversations"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op6_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.digest(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op8_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.search(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_quality_rules, op2_quotation, op3_mixing, op4_merge_dropout, op5_warc, op6_sanitise, op7_simhash, op8_block_search, op9_token_counts, op10_suffix_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.ORACLE, "op3_mixing": mixing.ORACLE, "op5_warc": warc.ORACLE, "op8_block_search": block_search.ORACLE, "op10_suffix_dedup": suffix_dedup.ORACLE}
