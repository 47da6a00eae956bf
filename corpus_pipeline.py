"""Documents to training sequences: clean, deduplicate, sanitise, mix and encode.

Every stage takes null and repeated keys, null, empty and very long texts, ties, repeated rows, empty tables and columns of any name
as its operator defines; all columns of the input pass through every stage but the last.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import merge_dropout, mixing, quality_rules, sanitise, simhash
from barloom.llm.common import delete_folder, ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that they remove."""
    return quality_rules.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; documents with null or equal keys are told apart by their texts."""
    return simhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it replaced."""
    return sanitise.sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken; those without a word are not."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and lossless of every document of the mix, each copy segmented on its own."""
    return merge_dropout.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), copies=True)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("personal_data", personal_data), ("mix_sources", mix), ("sentencepiece", encode)]

#: SQL cannot express fingerprint components or segmentation; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage gives is written as Parquet to the shared folder and read again by the next, which then deletes what it had read."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
