"""Queries of the numbered operators: thin wrappers that give the agreed result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (chat, decontaminate, exact_dedup, filter_audit, hard_negatives, language, maxent, mixing, near_dup,
                         sharding, token_count, toxicity, url_filter)
from tessera.llm.common import table

SHARDS = 16
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"))
    shards = sharding.assign_shards(docs, SHARDS)
    order = sharding.hash60(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                        F.col("text_crc32").cast("string")), 1)
    placed = sharding.with_slots(shards, "shard", order, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = mixing.taken_words(table(spark, sf_dir, "documents"))
    return t.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = toxicity.in_fold(F.col("doc_id"), 5)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    scored = docs.select("doc_id", (fold == 0).alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return c.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    decontaminate.items_digest(F.col("items")).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = toxicity.in_fold(F.col("doc_id"), 4)
    return language.identify(docs, fold != 2).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_token_count(spark: SparkSession, sf_dir: str, vocabulary: str = token_count.DEFAULT_VOCABULARY) -> DataFrame:
    tokens = token_count.read_vocabulary(spark, vocabulary)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", token_count.token_counts(F.col("text"), tokens).alias("c")).select("doc_id", "c.*")


def op11_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = toxicity.in_fold(F.col("doc_id"), 7) == 2
    scores = maxent.language_model_scores(table(spark, sf_dir, "documents"), ~held)
    return scores.select(F.col("id").alias("doc_id"), (toxicity.in_fold(F.col("id"), 7) == 2).alias("held_out"), "n_tokens",
                         "n_known", "train_tokens", "base_score", "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sharding, op2_url_filter, op3_mixing, op4_chat, op5_toxicity, op6_decontaminate, op7_near_dup,
        op8_language, op9_exact_dedup, op10_token_count, op11_maxent, op12_filter_audit, op13_hard_negatives)}
