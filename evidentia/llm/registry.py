"""The corpus operators' queries over the driver tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from evidentia.llm import bpe, centroids, decontam, html_text, line_dedup, near_dedup, passages, prefix_trie, quality_rules, sharding, token_blocks, token_rollup, url_filter
from evidentia.llm.shared import new_folder, table, vocabulary


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.roundtrip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=decontam.NEAR)
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_rollup.Rollup(spark, new_folder(spark, "token-rollup"))
    for batch, changes in token_rollup.document_changes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).items():
        store.commit(batch, changes)
    store.compact()
    return store.totals()


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_dropped", F.col("kept_text"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.labelled(table(spark, sf_dir, "embeddings"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_blocks, op3_near_dedup, op4_substring_dedup, op5_decontamination, op6_bpe, op7_sharding, op8_url_filter, op9_token_counts, op10_line_dedup, op11_prefix_trie, op12_centroids, op13_html_text, pipeline)}
ORACLE = {
    "op5_decontamination": decontam.ORACLE,
    "op7_sharding": sharding.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_centroids": centroids.ORACLE,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
