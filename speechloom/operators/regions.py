"""Speech regions from frame scores: hysteresis, min-cut, gap filling, packing into bounded chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from speechloom.params import Hysteresis
from speechloom.plans.blocks import (
    Scan, blocked_scan, chained_annotation, chained_fold, checkpointed, in_blocks, whole_rows,
)

CLASS_KEYS = ["recording_id", "class"]
FRAME_ORDER = ["t_us", "event_id"]
BLOCK_US = 86_400_000_000


def time_block(t: Column | str, width: int = BLOCK_US) -> Column:
    return F.floor((F.col(t) if isinstance(t, str) else t) / width)


def hysteresis(
    frames: DataFrame, params: Hysteresis, order: list[str] = FRAME_ORDER, block_us: int = BLOCK_US,
) -> DataFrame:
    """Regions ``(recording_id, class, region_idx, start_us, end_us)`` of frames held active by two thresholds.

    A frame above onset or below offset fixes the state, others inherit it. Inside a block the state and its
    rises come from windows; one summary row per block (first and last fixed state, rises seen) tells every
    block the state it is entered with and the number of its first region. Only edge frames are grouped into
    regions. A region still active ends at the last frame. Padding comes first; what has no length then is dropped, and
    the rest is numbered.
    """
    score = F.nanvl(F.col("score"), F.lit(None).cast("double"))
    base = in_blocks(frames.select(
        *CLASS_KEYS, *order, F.when(score > params.onset, 1).when(score < params.low, 0).alias("_fix"),
    ), CLASS_KEYS, time_block("t_us", block_us))
    inside = Window.partitionBy(*CLASS_KEYS, "_block").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumns({
        "_known": F.last("_fix", ignorenulls=True).over(before),
        "_end": F.lead(F.lit(1)).over(inside).isNull(),
    })
    fixed = F.coalesce("_fix", "_known")
    local = local.withColumn("_rise", ((F.col("_fix") == 1) & (F.col("_known") == 0)).cast("int"))
    summary = local.groupBy(*CLASS_KEYS, "_block").agg(
        F.max(F.when(F.col("_known").isNull(), F.col("_fix"))).alias("_first"),
        F.max(F.when(F.col("_end"), fixed)).alias("_last"),
        F.sum(F.coalesce("_rise", F.lit(0))).alias("_rises"), whole_rows(base),
    ).filter(F.col("_all").isNotNull())
    chain = Window.partitionBy(*CLASS_KEYS).orderBy("_block")
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    entered = F.coalesce(F.last("_last", ignorenulls=True).over(earlier), F.lit(0))
    carried = summary.select(
        *CLASS_KEYS, "_block", "_rises", entered.alias("_entry"),
        F.lead("_block").over(chain).isNull().alias("_final"),
        ((F.col("_first") == 1) & (entered == 0)).cast("int").alias("_opens"),
    ).withColumn("_opens", F.coalesce("_opens", F.lit(0)))
    carried = carried.withColumn(
        "_base", F.coalesce(F.sum(F.col("_rises") + F.col("_opens")).over(earlier), F.lit(0)) + F.col("_opens"))

    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = local.withColumn("_n", F.sum(F.coalesce("_rise", F.lit(0))).over(upto))
    placed = counted.join(carried.drop("_rises", "_opens"), [*CLASS_KEYS, "_block"])
    on, was = F.coalesce(fixed, F.col("_entry")), F.coalesce("_known", "_entry")
    rise, fall = (on == 1) & (was == 0), (on == 0) & (was == 1)
    tail = F.col("_end") & F.col("_final") & (on == 1)
    edges = placed.filter(rise | fall | tail)
    regions = edges.groupBy(*CLASS_KEYS, (F.col("_base") + F.col("_n") - 1).cast("bigint").alias("region_idx")).agg(
        F.min(F.when(rise, F.col("t_us"))).alias("start_us"),
        F.max(F.when(fall | tail, F.col("t_us"))).alias("end_us"))
    padded = regions.select(*CLASS_KEYS, (F.col("start_us") - params.pad_onset).alias("start_us"),
                            (F.col("end_us") + params.pad_offset).alias("end_us"))
    return number_regions(padded.filter(F.col("end_us") > F.col("start_us")), block_us=block_us)


def number_regions(regions: DataFrame, keys: list[str] = CLASS_KEYS, block_us: int = BLOCK_US) -> DataFrame:
    """0-based ``region_idx`` in time order."""
    numbered = blocked_scan(
        regions.select(*keys, "start_us", "end_us"), keys, time_block("start_us", block_us), ["start_us", "end_us"],
        [Scan("_n", "sum", F.lit(1))])
    return numbered.select(*keys, (F.col("_n") - 1).cast("bigint").alias("region_idx"), "start_us", "end_us")


def fill_gaps(
    regions: DataFrame, collar_us: int, keys: list[str] = CLASS_KEYS, block_us: int = BLOCK_US,
) -> DataFrame:
    """Merge regions that overlap or lie at most ``collar_us`` apart."""
    seen = blocked_scan(
        regions.select(*keys, "start_us", "end_us"), keys, time_block("start_us", block_us), ["start_us", "end_us"],
        [Scan("_reach", "max_before", F.col("end_us"))])
    new = F.col("_reach").isNull() | (F.col("start_us") > F.col("_reach") + collar_us)
    islands = blocked_scan(
        seen.select(*keys, "start_us", "end_us", new.cast("int").alias("_new")), keys, time_block("start_us", block_us), ["start_us", "end_us"],
        [Scan("_island", "sum", F.col("_new"))])
    return islands.groupBy(*keys, (F.col("_island") - 1).cast("bigint").alias("region_idx")).agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


def drop_short(regions: DataFrame, min_us: int) -> DataFrame:
    return regions.filter(F.col("end_us") - F.col("start_us") >= min_us)


def speech_regions(
    frames: DataFrame, params: Hysteresis, order: list[str] = FRAME_ORDER, block_us: int = BLOCK_US, *, max_us: int | None = None,
) -> DataFrame:
    """Regions of frames as a whole chain: thresholds, padding or cuts at ``max_us``, merging of what then overlaps or lies within
    ``min_off_us``, and removal of what is shorter than ``min_on_us``.

    Regions are merged only where padding or a minimum gap asks for it, so that cut pieces stay apart.
    """
    if max_us is None:
        regions = hysteresis(frames, params, order, block_us)
    else:
        regions = min_cut(frames, params, max_us, order)
    if params.pad_onset or params.pad_offset or params.min_off_us:
        regions = fill_gaps(regions, params.min_off_us, block_us=block_us)
    return drop_short(regions, params.min_on_us) if params.min_on_us else regions


def timeline(regions: DataFrame, block_us: int = BLOCK_US) -> DataFrame:
    """All classes of a recording as one ordered list of distinct intervals with an unknown speaker."""
    distinct = regions.filter(F.col("end_us") > F.col("start_us")).select(
        "recording_id", "start_us", "end_us").distinct()
    return number_regions(distinct, ["recording_id"], block_us).withColumn("speaker", F.lit("UNKNOWN"))


MIN_CUT_FIELDS = StructType([StructField("start_us", LongType()), StructField("end_us", LongType())])


def min_cut(
    frames: DataFrame, params: Hysteresis, max_us: int, order: list[str] = FRAME_ORDER,
    block_us: int | None = None,
) -> DataFrame:
    """Hysteresis regions where one longer than ``max_us`` is cut at the lowest score of its later half.

    Where a cut falls depends on the cut before, so this is a fold; its state is the open region and the
    scores since the last cut, which ``max_us`` bounds. Blocks span many such stretches, so that what a block
    leaves rarely depends on how it was entered.
    """
    block_us = block_us or 256 * max_us
    if params.pad_onset or params.pad_offset:
        raise ValueError("padding cannot be combined with a maximum duration")
    cut = _cutter(params.onset, params.low, max_us)
    narrow = frames.select(*CLASS_KEYS, *order, F.nanvl(F.col("score"), F.lit(None).cast("double")).alias("score"))
    pieces = chained_fold(narrow, CLASS_KEYS, time_block("t_us", block_us), order, cut, MIN_CUT_FIELDS)
    return number_regions(pieces.filter(F.col("end_us") > F.col("start_us")), block_us=block_us)


def _cutter(onset: float, low: float, max_us: int):
    """The fold of ``min_cut`` over frames in order, from event to event.

    Rises, falls and the frame at which a region gets too long are looked up in sorted positions; what may be cut at is a range
    of frames (with the last fall, or the first frame, in front of it). The state keeps those frames only.
    """

    def cut(state, rows: dict[str, list], final: bool):
        if state is None:
            held, start, active, idle = [[], []], None, None, 0
        else:
            held, start, active, idle = state
        seen = len(held[0])
        times = np.array(held[0] + rows["t_us"], np.int64)
        scores = np.array(held[1] + rows["score"], np.float64)
        depth = np.where(np.isnan(scores), np.inf, scores)
        rises, falls = np.flatnonzero(scores > onset), np.flatnonzero(scores < low)
        after = lambda places, at: int(places[k]) if (k := np.searchsorted(places, at)) < len(places) else len(times)
        if active is None:
            start, active, seen = int(times[0]), bool(scores[0] > onset), 1
        # Frames [idle, idle + 1) and [first, at) may be cut at; idle is None once a cut has passed it.
        first, at, starts, ends = (0 if idle is None else 1), seen, [], []
        if active and idle == 0 and state is None:
            first, idle = 0, None
        while at < len(times):
            if not active:
                at = after(rises, at)
                if at < len(times):
                    start, active, first, at = int(times[at]), True, at + 1, at + 1
                continue
            long = max(at, int(np.searchsorted(times, start + max_us, "right")))
            stop = min(long, after(falls, at))
            if stop == len(times):
                break
            starts.append(start)
            if stop == long:
                ahead = [] if idle is None else [idle]
                pool = np.concatenate([np.array(ahead, np.int64), np.arange(first, stop)])
                half = len(pool) // 2
                lowest = int(pool[half + int(np.argmin(depth[pool[half:]]))])
                first = first if lowest == idle else lowest + 1
                idle, start = None, int(times[lowest])
            else:
                start, active, idle = int(times[stop]), False, stop
            ends.append(start)
            at = stop + 1
        if final and active:
            starts.append(start)
            ends.append(int(times[-1]))
        kept = np.arange(first, len(times)) if active else np.zeros(0, np.int64)
        if idle is not None:
            kept = np.append(idle, kept)
        frames = [times[kept].tolist(), scores[kept].tolist()]
        return {"start_us": starts, "end_us": ends}, [frames, start, active, None if idle is None else 0]

    return cut


OPENS = StructType([StructField("opens", LongType())])


def pack_chunks(regions: DataFrame, chunk_us: int, block_us: int | None = None) -> DataFrame:
    """Pack consecutive regions into chunks of at most ``chunk_us``; a longer single region stays whole.

    Returns ``recording_id, chunk_idx, start_us, end_us, segments`` with the member intervals. The fold only
    decides which regions open a chunk; numbering and gathering are ordinary scans and groupings.
    """
    if chunk_us <= 0:
        raise ValueError("chunk size must be positive")
    block_us = block_us or 256 * chunk_us
    # Regions are few beside the frames they come from; written once, they are not derived anew per reader.
    opened = chained_annotation(
        checkpointed(regions.select("recording_id", "start_us", "end_us")), ["recording_id"],
        time_block("start_us", block_us), ["start_us", "end_us"], _opener(chunk_us), ["start_us", "end_us"], OPENS)
    numbered = blocked_scan(
        opened, ["recording_id"], time_block("start_us", block_us), ["start_us", "end_us"],
        [Scan("_n", "sum", F.col("opens"))])
    # Members of one chunk are bounded by its duration.
    return numbered.groupBy("recording_id", (F.col("_n") - 1).cast("bigint").alias("chunk_idx")).agg(
        F.min("start_us").alias("start_us"),
        F.max_by("end_us", F.struct("start_us", "end_us")).alias("end_us"),
        F.sort_array(F.collect_list(F.struct("start_us", "end_us"))).alias("segments"))


def _opener(chunk_us: int):
    def opens(state, rows: dict[str, list], final: bool):
        begin, reach = state or (None, None)
        flags = []
        for start, end in zip(rows["start_us"], rows["end_us"]):
            new = begin is None or (end - begin > chunk_us and reach > begin)
            if new:
                begin = start
            reach = end
            flags.append(int(new))
        return {"opens": flags}, [begin, reach]

    return opens


Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def score_with(blocks: DataFrame, scorer: Scorer, schema: str) -> DataFrame:
    """Run a region detector over signal blocks in Arrow batches; it yields frame scores or regions."""
    return blocks.mapInPandas(scorer, schema)


def chunks_from(
    detected: DataFrame, chunk_us: int, params: Hysteresis | None = None, *, cut: bool = True,
) -> DataFrame:
    """Chunks from what a detector yields: frame scores (made to regions first, and cut at the chunk size) or ready regions."""
    if "score" not in detected.columns:
        return pack_chunks(detected, chunk_us)
    regions = speech_regions(detected, params or Hysteresis(), max_us=chunk_us if cut else None)
    return pack_chunks(timeline(regions), chunk_us)
