"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litspark.llm import byte_bpe, conversation_trie, exact_dedup, filter_audit, html_text, language, line_dedup, minhash, mixing, pieces, quality, repeats, secrets
from litspark.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.mcd_quality(documents(spark, sf_dir))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_and_check(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(documents(spark, sf_dir)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(spark.read.parquet(f"{sf_dir}/pages.parquet"), documents(spark, sf_dir))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).drop("row_key")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.without_repeats(documents(spark, sf_dir)))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(byte_bpe.decode_bytes(byte_bpe.encode_bytes(documents(spark, sf_dir))))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("key")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_rules, op2_source_mix, op3_merge_dropout, op4_secret_scan, op5_language_id, op6_minhash_dedup, op7_line_dedup, op8_exact_dedup, op9_repeated_passages, op10_html_text, op11_byte_bpe, op12_filter_audit, op13_conversation_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": OP8, "op12_filter_audit": filter_audit.SQL}


OP8 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
