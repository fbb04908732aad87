"""Signal tables: ``signal(recording_id, sample_idx, value)`` and array blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from speechloom.functions.time import SAMPLE_RATE, seconds_to_sample

WINDOW, HOP = 400, 160
CHUNK_SAMPLES = 30 * SAMPLE_RATE
MIN_SAMPLES = 400
SAMPLE_BUCKET = 1 << 20


def pad_or_trim(samples: Column, length: int = CHUNK_SAMPLES) -> Column:
    """Exactly ``length`` samples: cut, or filled up with zeros."""
    size = F.size(samples)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(length) - size, F.lit(0)))
    return F.when(size >= length, F.slice(samples, 1, length)).otherwise(F.concat(samples, zeros))


def pad_to_minimum(samples: Column, length: int = MIN_SAMPLES) -> Column:
    """At least ``length`` samples; keep ``size(samples)`` beside it for the original length."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(length) - F.size(samples), F.lit(0)))
    return F.concat(samples, zeros)


def sample_ranges(chunks: DataFrame, rate: int = SAMPLE_RATE) -> DataFrame:
    """Half-open sample range ``[first, behind)`` of chunks given in seconds."""
    return chunks.withColumns({
        "first": seconds_to_sample(F.col("start"), rate), "behind": seconds_to_sample(F.col("end"), rate)})


def slice_signal(ranges: DataFrame, signal: DataFrame, bucket: int = SAMPLE_BUCKET) -> DataFrame:
    """Samples of every range: equi-join on (recording, sample bucket), so long recordings spread out."""
    parts = ranges.filter(F.col("behind") > F.col("first")).withColumn("_bucket", F.explode(F.sequence(
        F.floor(F.col("first") / bucket), F.floor((F.col("behind") - 1) / bucket))))
    samples = signal.withColumn("_bucket", F.floor(F.col("sample_idx") / bucket))
    return samples.join(parts, ["recording_id", "_bucket"]).filter(
        (F.col("sample_idx") >= F.col("first")) & (F.col("sample_idx") < F.col("behind"))).drop("_bucket")


def frame_ids(signal: DataFrame, window: int = WINDOW, hop: int = HOP) -> DataFrame:
    """Every sample once per frame it belongs to; frame ``f`` starts at ``f * hop``."""
    i = F.col("sample_idx")
    lowest = F.greatest(F.floor((i - window) / hop) + 1, F.lit(0))
    return signal.withColumn("frame_idx", F.explode(F.sequence(lowest, F.floor(i / hop))))


def frame_signal(signal: DataFrame, window: int = WINDOW, hop: int = HOP) -> DataFrame:
    """Frames as sample arrays, at most ``window`` long each."""
    return frame_ids(signal, window, hop).groupBy("recording_id", "frame_idx").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("sample_idx", "value"))), lambda s: s["value"]).alias("samples"))


def log_floor(values: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``(max(log10(max(x, 1e-10)), top - 8) + 4) / 4`` with ``top`` the maximum of the chunk in ``keys``."""
    logged = values.withColumn("_log", F.log10(F.greatest(F.col(value), F.lit(1e-10))))
    top = F.max("_log").over(Window.partitionBy(*keys))
    return logged.withColumn(value, (F.greatest(F.col("_log"), top - 8.0) + 4.0) / 4.0).drop("_log")


def head(signal: DataFrame, samples: int = CHUNK_SAMPLES) -> DataFrame:
    """The first samples of every recording with ``is_short`` for recordings that have fewer.

    The filter comes first, so at most ``samples`` rows per recording are counted.
    """
    first = signal.filter(F.col("sample_idx") < samples)
    sizes = first.groupBy("recording_id").agg((F.count("*") < samples).alias("is_short"))
    return first.join(sizes, "recording_id")
