"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read by the next.

Quality rules drop rejected documents, the n-gram join keeps one document of each group, benchmark
contamination drops documents, personal data is masked in the texts, and the mix says how many
words of each remaining document are taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.llm import mixing, ngram_join, private_data, quality_rules, winnowing
from salesloom.llm.storage import prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality verdict is kept."""
    verdicts = quality_rules.quality_verdicts(docs).filter("kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(verdicts, "doc_id", "left_semi").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies; a document without an id stays."""
    groups = ngram_join.ngram_jaccard_components(docs)
    gone = groups.filter("component < id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = winnowing.contamination(docs, items).filter("contaminated").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars follows the text."""
    masked = private_data.masked(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    rows = mixing.mixed(docs)
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


STAGES = [("quality_rules", quality), ("ngram_join", one_of_each), ("decontamination", decontaminated),
          ("private_data", without_private_data), ("mixing", mix)]
#: The verdicts of stages 1 and 4 depend on the method; a brute-force version in the tests covers them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stages are written below the checkpoint folder."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
