from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from speechloom.operators import regions as rg
from speechloom.params import Hysteresis


def frames(spark, scores, step=1):
    rows = [(1, "c", i * step, i, s) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "recording_id bigint, class string, t_us bigint, event_id bigint, score double")


def spans(df):
    return [(r.start_us, r.end_us) for r in df.orderBy("region_idx").collect()]


@pytest.mark.parametrize("scores, want", [
    ([0.6, 0.4, 0.4, 0.3], [(0, 3)]),
    ([0.1, 0.2, 0.9], []),
    ([0.1, 0.9, 0.4, 0.1, 0.45, 0.6, 0.6], [(1, 3), (5, 6)]),
    ([0.9, None, 0.9, float("nan"), 0.1], [(0, 4)]),
])
def test_hysteresis(spark, scores, want):
    levels = Hysteresis(0.5, 0.363)
    assert spans(rg.hysteresis(frames(spark, scores), levels)) == want
    assert spans(rg.min_cut(frames(spark, scores), levels, 1000)) == want


def test_min_cut_at_the_dip(spark):
    scores = [0.1, 0.9, 0.9, 0.9, 0.9, 0.9, 0.6, 0.9, 0.9, 0.9, 0.9, 0.1]
    assert spans(rg.min_cut(frames(spark, scores), Hysteresis(0.5, 0.3), 7)) == [(1, 6), (6, 11)]


def test_min_cut_refuses_padding(spark):
    with pytest.raises(ValueError):
        rg.min_cut(frames(spark, [0.9]), Hysteresis(0.5, pad_onset=1), 5)
    with pytest.raises(ValueError):
        Hysteresis(0.3, 0.5)


def regions(spark, pairs):
    return spark.createDataFrame([(1, a, b) for a, b in pairs], "recording_id bigint, start_us bigint, end_us bigint")


@pytest.mark.parametrize("pairs, want", [
    ([(0, 10), (12, 25), (26, 40)], [(0, 25, 2), (26, 40, 1)]),
    ([(5, 50)], [(5, 50, 1)]),
    ([(0, 5), (6, 60), (61, 70)], [(0, 5, 1), (6, 60, 1), (61, 70, 1)]),
])
def test_packing(spark, pairs, want):
    chunks = rg.pack_chunks(regions(spark, pairs), 30).orderBy("chunk_idx").collect()
    assert [(c.start_us, c.end_us, len(c.segments)) for c in chunks] == want


def test_gaps_and_timeline(spark):
    table = spark.createDataFrame(
        [(1, "a", 0, 10), (1, "a", 12, 20), (1, "a", 40, 50), (1, "a", 41, 45), (1, "b", 0, 10), (1, "b", 3, 3)],
        "recording_id bigint, class string, start_us bigint, end_us bigint")
    filled = rg.fill_gaps(table.filter("class = 'a'"), 2)
    assert spans(filled) == [(0, 20), (40, 50)]
    assert spans(rg.drop_short(filled, 11)) == [(0, 20)]
    assert spans(rg.timeline(table)) == [(0, 10), (12, 20), (40, 50), (41, 45)]


def test_detector_plug_in(spark):
    def detector(batches):
        for batch in batches:
            yield batch.assign(start_us=batch["t_us"], end_us=batch["t_us"] + 4)[["recording_id", "start_us", "end_us"]]

    found = rg.score_with(frames(spark, [0.1, 0.2], step=10), detector, "recording_id bigint, start_us bigint, end_us bigint")
    assert [(c.start_us, c.end_us) for c in rg.chunks_from(found, 30).collect()] == [(0, 14)]
    scored = frames(spark, [0.9, 0.9, 0.1, 0.1, 0.9, 0.1])
    assert [(c.start_us, c.end_us) for c in rg.chunks_from(scored, 30).collect()] == [(0, 5)]


def test_the_whole_chain_of_regions(spark):
    """Padded regions that meet are one, gaps up to the minimum close, short regions go last; cut pieces stay apart."""
    scores = [0, 9, 9, 0, 0, 9, 0, 0, 0, 0, 0, 0, 9, 0, 0, 0, 0, 0, 0, 9, 9, 9, 9, 9, 9, 0]
    frames = spark.createDataFrame([(1, "c", 10 * i, i, s / 9) for i, s in enumerate(scores)],
                                   "recording_id bigint, class string, t_us bigint, event_id bigint, score double")
    ends = lambda params, **more: [(r.start_us, r.end_us) for r in rg.speech_regions(frames, params, **more).orderBy("start_us").collect()]
    assert ends(Hysteresis()) == [(10, 30), (50, 60), (120, 130), (190, 250)]
    assert ends(Hysteresis(pad_onset=10, pad_offset=10)) == [(0, 70), (110, 140), (180, 260)]
    assert ends(Hysteresis(min_off_us=20)) == [(10, 60), (120, 130), (190, 250)]
    assert ends(Hysteresis(min_off_us=20, min_on_us=20)) == [(10, 60), (190, 250)]
    assert ends(Hysteresis(min_on_us=20)) == [(10, 30), (190, 250)]
    cut = ends(Hysteresis(), max_us=30)
    assert cut[:3] == [(10, 30), (50, 60), (120, 130)] and len(cut) > 4 and cut[-1][1] == 250
    chunks = rg.chunks_from(frames, 100, Hysteresis(min_off_us=20, min_on_us=20), cut=False).orderBy("chunk_idx").collect()
    assert [(c.start_us, c.end_us, len(c.segments)) for c in chunks] == [(10, 60, 1), (190, 250, 1)]
