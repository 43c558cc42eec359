"""Registered queries of the subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recframe.llm import (ann, bpe, chat, conversation_repair, decontaminate, filter_audit, license_scan, ngram_join, recompress, shard,
                          suffix_dedup, toxicity, warc)
from recframe.llm.common import table


def tokenizer_files() -> tuple[str, str]:
    """(rank file, split pattern) of the public vocabulary that operator 7 uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(table(spark, sf_dir, "documents"))


def op4_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_digest(table(spark, sf_dir, "documents"))


def op5_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.dedup_digest(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer_files())


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op11_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(table(spark, sf_dir, "pages"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digest(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_collision_ann, op3_license_scan, op4_hypergeometric_shards, op5_recompression_dedup,
              op6_toxicity, op7_byte_bpe, op8_perspective_rotation, op9_suffix_array_dedup, op10_ngram_jaccard_join, op11_warc_transactions,
              op12_filter_interactions, op13_conversation_repair)
}

SQL: dict[str, str] = {"op8_perspective_rotation": chat.SQL, "op11_warc_transactions": warc.SQL, "op12_filter_interactions": filter_audit.SQL,
                       "op13_conversation_repair": conversation_repair.SQL}
