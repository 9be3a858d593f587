"""Registered queries of the numbered operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.llm import (
    ball_codes, brown_lm, byte_trie, host_reputation, html_blocks, knn_quality, mixing, ngram_join, prefix_trie, private_data,
    quality_rules, substring_dedup, winnowing)
from salesloom.llm.oracle import ORACLE_SQL


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    rows = ngram_join.ngram_jaccard_components(table(spark, folder, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                       F.col("component").alias("component_id"))


def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mixed(table(spark, folder, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_private_data(spark: SparkSession, folder: str) -> DataFrame:
    rows = private_data.private_data_report(table(spark, folder, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone",
                       sha256(F.col("base")).alias("base_sha256"), "spans")


def op4_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    rows = winnowing.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
                       sha256(F.concat_ws(",", "items")).alias("items_sha256"), "contaminated")


def op5_neighbour_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = knn_quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rows.withColumnRenamed("id", "doc_id")


def op6_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of pages: quality labels of the documents whose number ends the url's path."""
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    url = F.col("url").cast("string")
    shown = pages.select(host_reputation.url_host(url).alias("host"),
                         F.regexp_extract(host_reputation.url_path(url), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).alias("number"))
    shown = shown.filter("number != ''").select("host", F.col("number").cast("long").alias("doc_id"))
    outcomes = shown.join(labels.groupBy("doc_id").agg(F.min("quality").alias("good")), "doc_id").select("host", "good")
    rules = spark.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(("action", "host", "path"), rule)])
        for rule in host_reputation.RULES])))
    rows = host_reputation.judge(pages, outcomes, rules)
    return rows.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "bound")


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_blocks.extract_main_text(table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.quality_verdicts(table(spark, folder, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "base_failed", "kept", "character_distance", "word_distance")


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), "n_removed", F.when(
        F.col("kept").isNull(), F.col("words_sha")).otherwise(sha256(F.col("kept"))).alias("kept_sha256"))


def op10_brown_lm(spark: SparkSession, folder: str) -> DataFrame:
    return brown_lm.score_texts(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op11_ball_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows = ball_codes.part_codes(table(spark, folder, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie_nodes(prefix_trie.rebuilt(table(spark, folder, "conversations")))


def op13_byte_trie(spark: SparkSession, folder: str) -> DataFrame:
    rows = byte_trie.exact_groups(table(spark, folder, "documents"), keep="max")
    return rows.select(F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), "kept",
                       F.col("sha").alias("text_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_source_mix, op3_private_data, op4_winnowing, op5_neighbour_quality, op6_host_reputation,
    op7_main_text, op8_quality_rules, op9_substring_dedup, op10_brown_lm, op11_ball_codes,
    op12_prefix_trie, op13_byte_trie)}
