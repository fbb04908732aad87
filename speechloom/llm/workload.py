"""The registered queries of this package and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from speechloom.llm import (
    digests, jaccard_join, language_id, mixing, piece_sampling, quality_rules, substring_dedup, token_alignment, token_counts, token_store,
    url_filter, vector_codes, vector_join)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), byte_tokenizer())


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.linked_vectors(_table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.page_languages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_cuts(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_facts(_table(spark, sf_dir, "documents"))


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sampled_pieces(_table(spark, sf_dir, "documents"), piece_model())


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(_table(spark, sf_dir, "documents"), byte_tokenizer())


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.exact_duplicates(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(_table(spark, sf_dir, "documents"), byte_tokenizer(), piece_model())


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_jaccard_join, op3_vector_join, op4_language_id,
    op5_suffix_dedup, op6_source_mixing, op7_quality_rules, op8_piece_sampling, op9_token_store, op10_url_filter,
    op11_exact_dedup, op12_vector_codes, op13_token_alignment)}
ORACLES = {"op3_vector_join": vector_join.ORACLE, "op6_source_mixing": mixing.ORACLE, "op7_quality_rules": quality_rules.ORACLE,
           "op10_url_filter": url_filter.ORACLE, "op11_exact_dedup": digests.ORACLE, "op12_vector_codes": vector_codes.ORACLE}
