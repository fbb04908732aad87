"""A training-data pipeline over ``documents``: filter by quality, drop near copies, cut repeats, mix sources, encode."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import speechloom
from speechloom.llm import jaccard_join, mixing, piece_sampling, quality_rules, substring_dedup, workload
from speechloom.plans.blocks import checkpointed

cloudpickle.register_pickle_by_value(speechloom)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns.

    A null or empty text has no words and goes; repeated rows are judged alike, a null id does not matter. Very long texts are judged whole. An empty
    table gives no rows.
    """
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by their word shingles, the one with the smallest id, with all its columns.

    Texts without words are linked with nothing and stay, as do rows with a null id; repeated rows of the id that stays all stay. Shingles
    are taken from whole texts. An empty table gives no rows.
    """
    return jaccard_join.first_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that a document with a smaller id has; ``n_chars`` counts anew.

    All rows and columns stay; null and empty texts and rows with a null id are left alone, repeated rows are one document, and a very
    long text is cut into segments. An empty table gives no rows.
    """
    return substring_dedup.cut_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in random order, with their own columns only.

    A null source is a source of its own; null and empty texts count one byte; rows of one id, null included, are drawn alike. An empty table
    gives no rows.
    """
    return mixing.mixed_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, checked by decoding.

    Null and empty texts have no pieces; copies of a document get equal pieces; very long texts are cut into units. An empty table gives no rows.
    """
    return piece_sampling.sampled_pieces(docs, workload.piece_model())


STAGES = [
    ("quality_rules", keep_good), ("jaccard_join", drop_near_copies), ("suffix_dedup", cut_repeats),
    ("source_mixing", mix_sources), ("sentence_pieces", encode_pieces),
]
#: Hash-seeded sampling by library vocabularies and shard suffix arrays have no SQL form; tests hold brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read back as the input of the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
