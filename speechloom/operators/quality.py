"""Decoded chunks: token clean-up, language choice, quality gate, batching, joining text to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from speechloom.functions.text import compression_ratio
from speechloom.params import QualityLimits
from speechloom.plans.blocks import Scan, blocked_scan, index_block

CHUNK = ["recording_id", "chunk_idx"]
NUMERAL_SIGNS = "[0-9%$£]"


def strip_special(tokens: Column, eot: int) -> Column:
    """Only ids below end-of-text."""
    return F.filter(tokens, lambda t: t < eot)


def avg_logprob(score: Column, tokens: Column, length_penalty: float = 1.0) -> Column:
    n = F.size(tokens)
    return score * F.pow(n.cast("double"), F.lit(length_penalty)) / (n + 1)


def numeral_tokens(vocabulary: DataFrame, eot: int) -> DataFrame:
    """Vocabulary entries with a digit, percent or currency sign behind at most one leading blank."""
    bare = F.regexp_replace("token", "^ ", "")
    return vocabulary.filter((F.col("token_id") < eot) & bare.rlike(NUMERAL_SIGNS))


def suppressed_tokens(numerals: DataFrame, given: DataFrame) -> DataFrame:
    """Distinct ids of both lists."""
    return numerals.select("token_id").union(given.select("token_id")).distinct()


#: Tokens of the rows that one block holds.
BLOCK_TOKENS = 1 << 19


def token_blocks(rows: DataFrame, eot: int) -> DataFrame:
    """Rows in blocks: ``block``, their keys, tokens per row, the block's distinct ids, and each token as a place among these."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists = batch.column("tokens")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK_TOKENS, prepend=0)).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                ids = part.column("tokens").flatten().cast(pa.int64())
                known = pc.fill_null(pc.less(ids, eot), False)
                owner = np.repeat(np.arange(b - a), sizes[a:b])[known.to_numpy(zero_copy_only=False)]
                coded = ids.filter(known).dictionary_encode()
                one = [*(part.column(c) for c in CHUNK), pa.array(np.bincount(owner, minlength=b - a)), coded.dictionary, coded.indices.cast(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), *[pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in one]],
                    names=["block", *CHUNK, "counts", "ids", "places"])
                block += 1

    keys = ", ".join(f"{c} array<{kinds[c]}>" for c in CHUNK)
    return rows.select(*CHUNK, "tokens").mapInArrow(run, f"block bigint, {keys}, counts array<bigint>, ids array<bigint>, places array<int>")


def detokenize(rows: DataFrame, vocabulary: DataFrame, eot: int) -> DataFrame:
    """Text of the token lists, special ids left out; unknown ids give nothing.

    Only the distinct ids of each block of rows meet the vocabulary; the words found come back as the block's own dictionary and
    are put in place there, so the order of tokens never leaves their row and the vocabulary may be of any size. ``token_id`` is
    unique in the vocabulary.
    """
    blocks = token_blocks(rows, eot)
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("ids").alias("at", "token_id"))
    words = asked.join(vocabulary.select(F.col("token_id").cast("bigint").alias("token_id"), "token"), "token_id").select("of", "at", "token")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def put_in_place(block: pa.Table, found: pa.Table) -> pa.Table:
        row = block.to_batches()[0]
        size = len(row.column("ids")[0])
        place = np.full(size, found.num_rows)
        place[found.column("at").to_numpy()] = np.arange(found.num_rows)
        tokens = pa.chunked_array([*found.column("token").chunks, pa.array([""], pa.string())]).combine_chunks()
        spelled = tokens.take(pa.array(place[row.column("places").flatten().to_numpy()]))
        bounds = np.concatenate([[0], np.cumsum(row.column("counts").flatten().to_numpy())])
        texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), spelled), "")
        return pa.table({**{c: row.column(c).flatten() for c in CHUNK}, "text": texts.cast(pa.string())})

    return blocks.select("block", *CHUNK, "counts", "ids", "places").groupBy("block").cogroup(words.groupBy("of")).applyInArrow(
        put_in_place, ", ".join([*(f"{c} {kinds[c]}" for c in CHUNK), "text string"]))


def quality_gate(segments: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Flag badly decoded and silent segments.

    Decoding fails by a high compression ratio or a low log-probability; a segment is silence if its no-speech
    probability is high and it failed by log-probability. A ``compression_ratio`` that the segments have already is taken.
    """
    unlikely = F.col("avg_logprob") < limits.avg_logprob
    rated = segments if "compression_ratio" in segments.columns else segments.withColumn(
        "compression_ratio", compression_ratio(F.col("text")))
    return rated.withColumns({
        "failed": (F.col("compression_ratio") > limits.compression_ratio) | unlikely,
        "silence": (F.col("no_speech_prob") > limits.no_speech) & unlikely,
    })


def detect_language(scores: DataFrame) -> DataFrame:
    """Most probable language of every recording, from tokens like ``<|en|>``; ties go to the smaller token."""
    best = scores.groupBy("recording_id").agg(F.min_by(
        F.struct("lang_token", "prob"), F.struct(-F.col("prob"), "lang_token")).alias("b"))
    token = F.col("b.lang_token")
    return best.select("recording_id", F.substring(token, F.lit(3), F.length(token) - 4).alias("language"),
                       F.col("b.prob").alias("prob"))


def batch_of(chunks: DataFrame, batch_size: int = 8) -> DataFrame:
    """Consecutive chunks of a recording in batches of ``batch_size``."""
    if batch_size < 1:
        raise ValueError("batch size must be positive")
    numbered = blocked_scan(chunks, ["recording_id"], index_block("chunk_idx"), ["chunk_idx"], [Scan("_n", "sum", F.lit(1))])
    return numbered.withColumn("batch", F.floor((F.col("_n") - 1) / batch_size).cast("bigint")).drop("_n")


def with_chunk_times(decoded: DataFrame, chunks: DataFrame) -> DataFrame:
    """Transcripts joined with their chunks by position; times in seconds to three decimals."""
    times = chunks.select(*CHUNK, (F.rint(F.col("start") * 1000) / 1000).alias("start"),
                          (F.rint(F.col("end") * 1000) / 1000).alias("end"))
    return decoded.join(times, CHUNK)
