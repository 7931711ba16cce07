"""The numbered corpus queries, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import alignment, bpe, contamination, html_text, importance, near_dups, pii, quality, secret_scan, substrings, token_counts, toxicity, url_filter
from plumbline.llm.common import small_batches, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encode_digests(table(spark, sf_dir, "documents"), RANKS)


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii.report(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 256)
    return substrings.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), RANKS)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return contamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dups.classes(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.hosts_with(pages))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.judge(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, megabytes=4)
    return alignment.scores(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secret_scan.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_html_text": op8_html_text,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_token_alignment": op12_token_alignment,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE_SQL: dict[str, str] = {"op9_url_filter": url_filter.ORACLE_SQL, "op11_importance_resampling": importance.ORACLE_SQL}
