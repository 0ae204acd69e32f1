"""Stages of corpus_pipeline.py: (spark, docs, sf_dir) -> DataFrame each, over all documents that the last one kept.

All but the last return the rows of docs that stay, with the columns as they came. Rows with nulls, empty and very long
texts go through every stage; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import op4_byte_bpe, op5_near_duplicates, op6_decontaminate, op7_toxicity, op8_quality_rules
from .common import WRITING, shared_path, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict to be toxic."""
    return op7_toxicity.score(docs, op7_toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=True)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the isolation forest reject."""
    return op8_quality_rules.rate(docs, op8_quality_rules.fit(docs, table(spark, sf_dir, "labels")), keep=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return op5_near_duplicates.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return op6_decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, their number, and digests of the ids and of what they decode to."""
    return op4_byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str, stages=STAGES) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(stages):
        path = shared_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.options(**WRITING).parquet(path)
        docs = spark.read.parquet(path)
    return docs
