"""The training-corpus pipeline: STAGES in order, each over all that its predecessor kept.

Quality rules drop failing lines and the documents that lose too much; near-duplicate groups keep one
document; strings that an earlier document has are cut out; sources are mixed to their target weights
(a row stands for each copy taken); the last stage encodes each row. All stages but the last return the
columns of their input.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ctxloom.llm import bpe, mixing, quality, simhash, suffix
from ctxloom.llm.common import new_path, remove, scope, spill_to


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality", quality_rules), ("simhash", near_dedup), ("suffix", repeat_removal), ("mixing", source_mix), ("bpe", token_ids)]

#: SQL has no XXH64 fingerprints, entropy balancing or merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with scope(spark):  # what a stage leaves behind goes once its result is written, and so does its input
            docs = spill_to(stage(spark, docs, sf_dir), path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
