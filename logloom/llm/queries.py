"""The registered queries of this subpackage: name -> (function, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import (byte_bpe, chosen_path, embed_dedup, exact_dedup, lm_bloom, mixing, packing, secret_scan,
                         substring_dedup, toxicity, turn_repair, url_filter, vector_codes)
from logloom.llm.common import read


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.score_report(read(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_report(read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digest(read(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_report(read(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_report(read(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_report(read(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.damage_report(read(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(read(spark, sf_dir, "embeddings"))


REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_lm_scoring": (op1_lm_scoring, None),
    "op2_minhash_near_dedup": (op2_minhash_near_dedup, chosen_path.SQL),
    "op3_exact_dedup": (op3_exact_dedup, exact_dedup.SQL),
    "op4_embedding_near_dedup": (op4_embedding_near_dedup, embed_dedup.SQL),
    "op5_substring_dedup": (op5_substring_dedup, substring_dedup.SQL),
    "op6_mix_sources": (op6_mix_sources, mixing.SQL),
    "op7_best_fit_packing": (op7_best_fit_packing, None),
    "op8_url_filter": (op8_url_filter, url_filter.sql()),
    "op9_toxicity": (op9_toxicity, None),
    "op10_secret_scan": (op10_secret_scan, secret_scan.sql()),
    "op11_byte_bpe": (op11_byte_bpe, None),
    "op12_turn_repair": (op12_turn_repair, turn_repair.SQL),
    "op13_vector_codes": (op13_vector_codes, vector_codes.SQL),
}
