"""The corpus pipeline: five stages, each an operator of lodestar.llm applied to what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontaminate, importance, mixing, secrets, simhash
from lodestar.session import shared_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the resampling doesn't draw go.

    A null or empty text has weight 1 and is drawn as such; null doc_ids, repeated rows and ties at the last place stay
    together; without good labels, and from an empty table, everything stays.
    """
    return importance.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id, null ones last.

    Null, empty and blank texts are one group; of rows that are equal as a whole one stays. An empty table stays empty.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go.

    Null and empty texts hold none; repeated rows stay or go together. An empty table or benchmark changes nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark, and n_chars follows.

    Texts without one, null and empty ones among them, are unchanged; repeated rows are treated alike. An empty table stays empty.
    """
    return secrets.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each draw of the mix, with its shard and its place there.

    Texts without words are never drawn. A null source is a source, the last; repeated rows are rows of their own. An empty
    table gives no rows.
    """
    return mixing.drawn(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
]

#: Hashed-model weights, graph components and alignments aren't SQL; tests compare the rows with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written as Parquet to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
