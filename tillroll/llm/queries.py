"""The registered queries: each applies its operator to a whole table and returns the contract's columns."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (
    bpe_tree,
    chat,
    decontaminate,
    exact_dedup,
    fill_in_middle,
    line_dedup,
    near_dup,
    prefix_counts,
    prefix_trie,
    quality_classifier,
    quality_rules,
    sql,
    suffix_dedup,
    token_store,
)
from tillroll.llm.common import deploy, read, sha256


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_counts.prefix_counts(read(spark, sf_dir, "documents"), budgets=(1024,), store=False)
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_tokens(read(spark, sf_dir, "documents"))
    return token_store.read_documents(spark, path, with_ids=False)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256(F.col("kept_text")).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_lines", sha256(F.col("kept_text")).alias("kept_text_sha256"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.classify(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return bpe_tree.encode_decode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(
        "SELECT -1L conv_id, CAST(turn AS BIGINT) turn, role, '</s>[INST] ok [/INST]' text "
        "FROM VALUES (0, 'user'), (1, 'assistant') t(turn, role)"
    )
    messages = given.unionByName(planted).withColumn("parts", chat.text_part(F.col("text")))
    return chat.chat_digests(chat.read_chats(chat.format_chats(messages.drop("text"))))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("item_ids")).alias("items_sha256"),
        "contaminated",
    )


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha256(F.col("output")).alias("output_sha256"), sha256(text).alias("restored_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which of several children comes first in the tour is open, so its positions are no part of the result
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations")).drop("enter_at", "leave_at")


def _deployed(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        deploy(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_token_counts, op2_token_store, op3_line_dedup, op4_quality_rules, op5_quality_classifier,
        op6_bpe_tree, op7_suffix_dedup, op8_chat_formatting, op9_decontamination, op10_near_dup,
        op11_exact_dedup, op12_fill_in_middle, op13_prefix_trie,
    )
    return {f.__name__: _deployed(f) for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(sql.QUERIES)
