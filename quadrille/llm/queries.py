"""The contract queries, opN_<name>, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, jaccard_join, language_id, license_scan, lm_scoring, oracles, packing, quality_rules, token_counts, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_documents(spark, sf_dir)).drop("places")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.group(_documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language_id.learn(docs, language_id.held_out_fold())
    return language_id.identify(docs, model).select("doc_id", language_id.held_out_fold().alias("held_out"), "lang_pred", "score")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chat_format.as_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    held_out = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return chat_format.format_chats(lines, held_out).withColumn("held_out", held_out)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_documents(spark, sf_dir).select("doc_id", "text", "source"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *base, "base_failed", "kept", "removed_chars")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_lm_scoring, op4_jaccard_join, op5_language_id, op6_chat_format, op7_warc, op8_quality_rules, op9_packing, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
