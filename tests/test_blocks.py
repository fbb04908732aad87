"""Blocked scans and chained folds must not depend on where blocks end."""

from __future__ import annotations

import os
import random

from pyspark.sql import Window, functions as F

from speechloom.operators import cues as cu, regions as rg
from speechloom.params import CueLimits, Hysteresis
from speechloom.plans.blocks import Scan, blocked_scan, checkpointed


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def frame_table(spark, seed=3, keys=3, n=400):
    """One key holds most rows."""
    rng = random.Random(seed)
    rows = []
    for k in range(keys):
        t = 0
        for i in range(n if k == 0 else 40):
            t += rng.choice([1, 1, 1, 2, 5])
            rows.append((k, "c", t, i, rng.choice([0.1, 0.2, 0.4, 0.45, 0.6, 0.9])))
    return spark.createDataFrame(rows, "recording_id bigint, class string, t_us bigint, event_id bigint, score double")


def test_blocked_scan_equals_plain_windows(spark):
    frames = frame_table(spark).withColumn("v", F.when(F.col("score") > 0.4, F.col("event_id")))
    scans = [Scan("s", "sum", F.col("v")), Scan("l", "last", F.col("v")), Scan("p", "prev", F.col("v")),
             Scan("n", "next", F.col("v")), Scan("a", "ahead", F.col("v")), Scan("m", "max_before", F.col("v")),
             Scan("t", "total", F.lit(1))]
    got = blocked_scan(frames, ["recording_id"], F.floor(F.col("t_us") / 7), ["t_us", "event_id"], scans)
    w = Window.partitionBy("recording_id").orderBy("t_us", "event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = frames.withColumns({
        "s": F.coalesce(F.sum("v").over(upto), F.lit(0)), "l": F.last("v", True).over(upto),
        "p": F.last("v", True).over(before), "n": F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        "a": F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)), "m": F.max("v").over(before),
        "t": F.count("*").over(Window.partitionBy("recording_id"))})
    assert rows_of(got) == rows_of(want)


def test_hysteresis_over_block_borders(spark):
    levels = Hysteresis(0.5, 0.3)
    frames = frame_table(spark)
    whole = rows_of(rg.hysteresis(frames, levels, block_us=1 << 40))
    assert len(whole) > 20
    for width in (1, 3, 50):
        assert rows_of(rg.hysteresis(frames, levels, block_us=width)) == whole


def test_min_cut_over_block_borders(spark):
    levels = Hysteresis(0.5, 0.15)
    frames = frame_table(spark)
    whole = rows_of(rg.min_cut(frames, levels, 12, block_us=1 << 40))
    assert len(whole) > 20
    assert rows_of(rg.min_cut(frames, levels, 12, block_us=60)) == whole


def test_packing_over_block_borders(spark):
    regions = rg.timeline(rg.hysteresis(frame_table(spark), Hysteresis(0.5, 0.3)))
    whole = rows_of(rg.pack_chunks(regions, 40, block_us=1 << 40))
    assert len(whole) > 10
    assert rows_of(rg.pack_chunks(regions, 40, block_us=90)) == whole


def test_limited_cues_over_block_borders(spark):
    rng = random.Random(5)
    rows = []
    for seg in range(12):
        words = [("w" * rng.randint(1, 9), seg * 10_000 + 300 * i, seg * 10_000 + 300 * i + 200)
                 for i in range(rng.randint(0, 12))]
        rows.append((1, seg, "s", "en", "t", seg * 10_000, seg * 10_000 + 9_000, words))
    nested = spark.createDataFrame(rows, "recording_id bigint, segment_idx bigint, speaker string, lang string, text string,"
                                         " start_ms bigint, end_ms bigint,"
                                         " words array<struct<word:string,start_ms:bigint,end_ms:bigint>>")
    for limits in (CueLimits(20, 2), CueLimits(None, 1)):
        whole = rows_of(cu.cues_limited(nested, limits))
        assert rows_of(cu.cues_limited(nested, limits, segments_per_block=2)) == whole
        for row in cu.cues_limited(nested, limits).collect():
            assert row["text"] == "[s]: " + " ".join(w["word"] for w in row["words"])
            assert all(len(line.replace(" ", "")) <= limits.width for line in row["text"][5:].split("\n"))


def periodic_regions(blocks, phase=0):
    """Regions of equal length end to end: where a chunk opens depends on all rows before, and no block forgets it."""
    return [(1, 10 * i + phase, 10 * i + 10 + phase) for i in range(blocks * 9)]


def rounds_of(monkeypatch):
    from speechloom.plans import blocks

    made, walk = [], blocks._walked
    monkeypatch.setattr(blocks, "_walked", lambda *a: made.append(1) or walk(*a))
    return made


def test_blocks_that_never_forget_settle_in_few_rounds(monkeypatch, spark):
    """64 adjoining blocks of a period that does not divide them, and a second key."""
    rounds = rounds_of(monkeypatch)
    rows = periodic_regions(64) + [(2, 7 * i, 7 * i + 5) for i in range(200)]
    regions = spark.createDataFrame(rows, "recording_id bigint, start_us bigint, end_us bigint")
    got = rows_of(rg.pack_chunks(regions, 40, block_us=90))
    assert 1 <= len(rounds) <= 8
    assert got == rows_of(rg.pack_chunks(regions, 40, block_us=1 << 40))


def test_groups_of_blocks_are_composed(monkeypatch, spark):
    from speechloom.plans import blocks

    monkeypatch.setattr(blocks, "BLOCKS_PER_GROUP", 4)
    rounds = rounds_of(monkeypatch)
    regions = spark.createDataFrame(periodic_regions(30, 3), "recording_id bigint, start_us bigint, end_us bigint")
    assert rows_of(rg.pack_chunks(regions, 70, block_us=90)) == rows_of(rg.pack_chunks(regions, 70, block_us=1 << 40))
    assert len(rounds) <= 8


def test_states_outside_the_maps_are_added(monkeypatch, spark):
    """With no guesses but the block's own beginning, further rounds still settle every block."""
    from speechloom.plans import blocks

    monkeypatch.setattr(blocks, "TAIL_ROWS", 1)
    regions = spark.createDataFrame(periodic_regions(6), "recording_id bigint, start_us bigint, end_us bigint")
    assert rows_of(rg.pack_chunks(regions, 70, block_us=90)) == rows_of(rg.pack_chunks(regions, 70, block_us=1 << 40))


def test_shuffle_files_go_when_a_table_is_written(spark):
    folders = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs())
    files = lambda: {f for d in folders for _, _, names in os.walk(str(d)) for f in names if f.startswith("shuffle_")}
    before = files()
    rows = spark.range(2000).repartition(7, "id").groupBy((F.col("id") % 5).alias("k")).count()
    table = checkpointed(rows.join(spark.range(5).withColumnRenamed("id", "k").repartition(3, "k"), "k"))
    assert not files() - before
    assert rows_of(table) == [(400, k) for k in range(5)]
    rows.collect()
    assert files() - before  # only what is written as a table ends with its write
