"""Progress of long jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from speechloom.functions.fixed_values import DEFAULT_PROGRESS_RANGE, PROGRESS_STEPS
from speechloom.plans.blocks import Scan, blocked_scan, index_block

BLOCK_US = 86_400_000_000


def percent_done(segments: DataFrame) -> DataFrame:
    """Percent after each segment, and its share when two passes count half each."""
    counted = blocked_scan(
        segments.select("recording_id", "segment_idx"), ["recording_id"], index_block("segment_idx"), ["segment_idx"],
        [Scan("_k", "sum", F.lit(1)), Scan("_n", "total", F.lit(1))])
    pct = F.col("_k") / F.col("_n") * 100
    return counted.select("recording_id", "segment_idx", pct.alias("percent"),
                          (pct / 2).alias("first_pass"), (pct / 2 + 50).alias("second_pass"))


def step_percent(step: Column, completed: Column, total: Column) -> Column:
    """Position within the range of the step; null without a usable total."""
    def within(bounds: tuple[float, float]) -> Column:
        low, high = bounds
        return F.lit(low) + F.least(completed / total, F.lit(1.0)) * (high - low)

    pct = within(DEFAULT_PROGRESS_RANGE)
    for name, bounds in PROGRESS_STEPS.items():
        pct = F.when(step == name, within(bounds)).otherwise(pct)
    return F.when(total > 0, pct)


def monotone_progress(events: DataFrame, order: list[str], block: Column) -> DataFrame:
    """Reports that exceed all earlier ones of the recording, and a closing 100.

    ``events``: ``recording_id, step, completed, total`` and the ``order`` columns; the closing row has null order.
    """
    rated = events.select("recording_id", *order, step_percent(
        F.col("step"), F.col("completed"), F.col("total")).alias("percent"))
    seen = blocked_scan(rated, ["recording_id"], block, order, [Scan("_top", "max_before", F.col("percent"))])
    raised = seen.filter(F.col("percent") > F.greatest(F.coalesce("_top", F.lit(0.0)), F.lit(0.0))).drop("_top")
    closing = rated.select("recording_id").distinct().select(
        "recording_id", *[F.lit(None).cast(rated.schema[c].dataType).alias(c) for c in order], F.lit(100.0).alias("percent"))
    return raised.unionByName(closing)
