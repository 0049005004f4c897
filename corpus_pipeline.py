"""A training corpus from `documents`: five stages, each over all that the one before kept.

1. quality_rules: documents that the rules or the model of labels.quality reject go.
2. near_dedup: one document of every group of near-duplicates stays.
3. personal_data: personal data in the texts is masked by its kind.
4. mix_sources: documents as often as the mix of sources takes them.
5. sentencepiece: token ids of every document, and whether they decode to its very text.

Every stage is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larder.llm import mixing, near_dedup, pii, quality, sentencepiece_codec
from larder.llm.staging import new_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.kept_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

# Trained trees, hashed signatures, graph scores and merges are not SQL: the stages are
# tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
