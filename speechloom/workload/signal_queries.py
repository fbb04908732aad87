"""Signal operators on event values and embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechloom.functions import time as tm
from speechloom.operators import signal as sg
from speechloom.sources import corpus, recordings
from speechloom.workload.registry import query

RANGES = "SELECT event_id, user_id AS recording_id, value AS start, value + value / 7.0 AS \"end\" FROM events"


def _spans(spark, sf_dir):
    return corpus.table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("recording_id"), F.col("value").alias("start"),
        (F.col("value") + F.col("value") / 7.0).alias("end"))


@query("pcm_scale", """
    SELECT vec_id AS recording_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
      CAST(round_even(unnest(embedding)::DOUBLE * 30000, 0) AS BIGINT) / 32768.0 AS value FROM embeddings""")
def pcm_scale(spark, sf_dir):
    pcm = F.transform("samples", lambda x: F.rint(x.cast("double") * 30000).cast("smallint"))
    return corpus.sample_blocks(spark, sf_dir).select(
        "recording_id", F.posexplode(recordings.scale_pcm(pcm)).alias("pos", "_v")).select(
        "recording_id", "pos", F.col("_v").cast("double").alias("value"))


@query("sample_ranges", f"""
    SELECT event_id, CAST(trunc(start * 16000.0) AS BIGINT) AS first, CAST(trunc("end" * 16000.0) AS BIGINT) AS behind
    FROM ({RANGES})""")
def sample_ranges(spark, sf_dir):
    return sg.sample_ranges(_spans(spark, sf_dir)).select("event_id", "first", "behind")


@query("samples_to_sec", "SELECT event_id, event_id * 37 / 16000.0::DOUBLE AS seconds FROM events")
def samples_to_sec(spark, sf_dir):
    return corpus.table(spark, sf_dir, "events").select(
        "event_id", tm.samples_to_seconds(F.col("event_id") * 37, F.lit(16000)).alias("seconds"))


@query("pad_or_trim", """
    WITH cut AS (SELECT vec_id, embedding[1:1 + vec_id % 64] AS s FROM embeddings),
    long AS (SELECT vec_id, unnest(range(40)) AS i, s FROM cut)
    SELECT vec_id AS recording_id, CAST(i AS INTEGER) AS pos, coalesce(s[i + 1], 0)::DOUBLE AS value FROM long""")
def pad_or_trim(spark, sf_dir):
    cut = corpus.sample_blocks(spark, sf_dir).withColumn(
        "samples", F.slice("samples", F.lit(1), (F.col("recording_id") % 64 + 1).cast("int")))
    return cut.select("recording_id", F.posexplode(sg.pad_or_trim(F.col("samples"), 40)).alias("pos", "_v")).select(
        "recording_id", "pos", F.col("_v").cast("double").alias("value"))


@query("min_pad", """
    WITH cut AS (SELECT vec_id, embedding[1:1 + vec_id % 64] AS s FROM embeddings)
    SELECT vec_id AS recording_id, len(s)::INTEGER AS n_original, greatest(len(s), 40)::INTEGER AS n_padded,
      CASE WHEN len(s) >= 40 THEN s[len(s)] ELSE 0 END::DOUBLE AS final FROM cut""")
def min_pad(spark, sf_dir):
    cut = corpus.sample_blocks(spark, sf_dir).withColumn(
        "samples", F.slice("samples", F.lit(1), (F.col("recording_id") % 64 + 1).cast("int")))
    padded = sg.pad_to_minimum(F.col("samples"), 40)
    return cut.select("recording_id", F.size("samples").alias("n_original"), F.size(padded).alias("n_padded"),
                      F.element_at(padded, -1).cast("double").alias("final"))


@query("frame_signal", """
    WITH f AS (
      SELECT recording_id, sample_idx, value, unnest(range(greatest(sample_idx // 3 - 3, 0), sample_idx // 3 + 1)) AS frame_idx
      FROM signal)
    SELECT recording_id, frame_idx, count(*) AS n, sum(CAST(round_even(value * 100, 0) AS BIGINT))::BIGINT AS total,
      string_agg(CAST(round_even(value * 100, 0) AS BIGINT), ',' ORDER BY sample_idx) AS samples
    FROM f WHERE frame_idx * 3 <= sample_idx AND sample_idx < frame_idx * 3 + 8 GROUP BY ALL""", using=("signal",))
def frame_signal(spark, sf_dir):
    cents = corpus.signal(spark, sf_dir).withColumn("value", F.rint(F.col("value") * 100).cast("bigint"))
    framed = sg.frame_signal(cents, 8, 3)
    return framed.select("recording_id", "frame_idx", F.size("samples").cast("bigint").alias("n"),
                         F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
                         F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@query("log_floor", """
    WITH g AS (SELECT recording_id, sample_idx // 20 AS chunk, sample_idx, log10(greatest(value * value * value, 1e-10)) AS l FROM signal)
    SELECT recording_id, sample_idx, round_even((greatest(l, max(l) OVER (PARTITION BY recording_id, chunk) - 8.0) + 4.0)
      / 4.0 * 1000000, 0)::BIGINT AS micro FROM g""", using=("signal",))
def log_floor(spark, sf_dir):
    cubed = corpus.signal(spark, sf_dir).select(
        "recording_id", F.floor(F.col("sample_idx") / 20).alias("chunk"), "sample_idx",
        (F.col("value") * F.col("value") * F.col("value")).alias("value"))
    return sg.log_floor(cubed, "value", ["recording_id", "chunk"]).select(
        "recording_id", "sample_idx", F.rint(F.col("value") * 1000000).cast("bigint").alias("micro"))


@query("slice_signal", """
    WITH c AS (SELECT user_id AS recording_id, event_id, CAST(trunc(value / 4.0) AS BIGINT) AS first,
        CAST(trunc(value / 3.0) AS BIGINT) AS behind FROM events)
    SELECT c.recording_id, c.event_id, count(*) AS n, sum(CAST(round_even(s.value * 100, 0) AS BIGINT))::BIGINT AS total
    FROM c JOIN signal s ON s.recording_id = c.recording_id AND s.sample_idx >= c.first AND s.sample_idx < c.behind
    GROUP BY ALL""", using=("signal",))
def slice_signal(spark, sf_dir):
    events = corpus.table(spark, sf_dir, "events")
    ranges = events.select(
        F.col("user_id").alias("recording_id"), "event_id", (F.col("value") / 4.0).cast("bigint").alias("first"),
        (F.col("value") / 3.0).cast("bigint").alias("behind"))
    cut = sg.slice_signal(ranges, corpus.signal(spark, sf_dir), bucket=64)
    return cut.groupBy("recording_id", "event_id").agg(
        F.count("*").alias("n"), F.sum(F.rint(F.col("value") * 100).cast("bigint")).alias("total"))


@query("head_30s", """
    SELECT recording_id, sample_idx, value, count(*) OVER (PARTITION BY recording_id) < 60 AS is_short
    FROM signal WHERE sample_idx < 60""", using=("signal",))
def head_30s(spark, sf_dir):
    return sg.head(corpus.signal(spark, sf_dir), 60)
