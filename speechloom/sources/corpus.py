"""Speech-like tables derived from the given parquet tables.

Everything is integer milliseconds (or microseconds for frame clocks), so engines agree exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType

from speechloom.functions.text import words_with_offsets
from speechloom.plans.blocks import Scan, blocked_scan, index_block

MS_PER_CHAR = 60
DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recording_id, segment_idx, speaker, text, start_ms, end_ms``: turns laid end to end."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("recording_id"), F.col("turn").alias("segment_idx"),
        F.col("role").alias("speaker"), "text",
        (F.length("text") * MS_PER_CHAR).cast("bigint").alias("_len"),
    )
    timed = blocked_scan(
        turns, ["recording_id"], index_block("segment_idx"), ["segment_idx"],
        [Scan("end_ms", "sum", F.col("_len"))],
    )
    return timed.select(
        "recording_id", "segment_idx", "speaker", "text",
        (F.col("end_ms") - F.col("_len")).alias("start_ms"), "end_ms",
    )


def words(segments: DataFrame) -> DataFrame:
    """``recording_id, segment_idx, pos, word, start_ms, end_ms``, without a shuffle."""
    exploded = segments.select(
        "recording_id", "segment_idx", F.col("start_ms").alias("_t0"),
        F.posexplode(words_with_offsets(F.col("text"))).alias("pos", "_w"),
    )
    start = F.col("_t0") + F.col("_w.offset") * MS_PER_CHAR
    return exploded.select(
        "recording_id", "segment_idx", "pos", F.col("_w.word").alias("word"),
        start.alias("start_ms"), (start + F.length("_w.word") * MS_PER_CHAR).alias("end_ms"),
    )


def null_words(word_table: DataFrame) -> DataFrame:
    """Words whose times are partly unknown: no start where a sign outside a-z occurs, no end for capitalised ones."""
    plain = F.col("word").rlike("^[a-zA-Z]+$")
    capital = F.col("word").rlike("^[A-Z]")
    return word_table.withColumns({
        "start_ms": F.when(plain, F.col("start_ms")),
        "end_ms": F.when(plain & ~capital, F.col("end_ms")),
    })


def speaker_turns(segments: DataFrame) -> DataFrame:
    """``recording_id, turn_idx, track, speaker, start_ms, end_ms``: overhanging and clipped turns in alternation."""
    quarter = F.floor((F.col("end_ms") - F.col("start_ms")) / 4)
    wide = F.col("segment_idx") % 2 == 0
    return segments.select(
        "recording_id", F.col("segment_idx").alias("turn_idx"),
        F.concat(F.lit("T"), F.col("segment_idx").cast("string")).alias("track"), "speaker",
        F.when(wide, F.greatest(F.col("start_ms") - 3000, F.lit(0))).otherwise(F.col("start_ms") + quarter)
        .cast("bigint").alias("start_ms"),
        F.when(wide, F.col("end_ms") + 1500).otherwise(F.col("end_ms") - quarter).cast("bigint").alias("end_ms"),
    )


def score_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recording_id, class, t_us, event_id, score``; ``(t_us, event_id)`` orders the frames of a class."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("recording_id"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), "front").otherwise("back").alias("class"),
        micros(F.col("ts")).alias("t_us"), "event_id", F.col("value").alias("score"),
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recording_id, sample_idx, value``: the values of a user numbered in time order."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording_id"), micros(F.col("ts")).alias("t_us"), "event_id", "value",
    )
    numbered = blocked_scan(
        events, ["recording_id"], F.floor(F.col("t_us") / DAY_US), ["t_us", "event_id"],
        [Scan("_n", "sum", F.lit(1))],
    )
    return numbered.select(
        "recording_id", (F.col("_n") - 1).cast("bigint").alias("sample_idx"), "value",
    )


def sample_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recording_id, samples array<float>``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("recording_id"), F.col("embedding").alias("samples"),
    )


#: Ids of words lie below; from here on ids are special tokens.
EOT = 1 << 60
SPECIAL = {EOT: "<|end|>", EOT + 1: "<|start|>", EOT + 2: "<|0.00|>"}


def token_id(word: Column) -> Column:
    """A 60-bit id from the word itself: numbering a vocabulary would need one global order."""
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("bigint")


@F.arrow_udf(ArrayType(LongType()))
def word_ids(texts: pa.Array) -> pa.Array:
    """``token_id`` of the blank-separated words of every text, each distinct word of a batch hashed once."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    ids = np.array([int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in coded.dictionary.to_pylist()], dtype=np.int64)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(ids).take(coded.indices), mask=texts.is_null())


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recording_id, pos, word`` of all documents."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("recording_id"), F.posexplode(F.split("text", " ", -1)).alias("pos", "word"),
    )


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token_id, token``: every distinct word, with the blank in front that sub-word tokenizers keep, and the special tokens."""
    distinct = document_words(spark, sf_dir).select("word").distinct()
    words_ = distinct.select(
        token_id(F.col("word")).alias("token_id"), F.concat(F.lit(" "), F.col("word")).alias("token"),
    )
    # Ids are hashes of words; should two words share one, the smaller stands for it, so that joins never multiply rows.
    special = spark.createDataFrame(list(SPECIAL.items()), "token_id bigint, token string")
    return words_.groupBy("token_id").agg(F.min("token").alias("token")).union(special)


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recording_id, chunk_idx, tokens, score, no_speech_prob``; special tokens open and close every list."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("recording_id"), F.lit(0).cast("bigint").alias("chunk_idx"),
        F.concat(F.array(F.lit(EOT + 1), F.lit(EOT + 2)), word_ids("text"),
                 F.array(F.lit(EOT))).alias("tokens"),
        (-(F.col("n_chars") % 300) / 100.0).alias("score"),
        ((F.col("n_chars") % 100) / 100.0).alias("no_speech_prob"),
    )
