from __future__ import annotations

import random

import pytest

from speechloom.operators import speakers as sp

TURNS = "recording_id bigint, turn_idx bigint, speaker string, start_ms bigint, end_ms bigint"
ITEMS = "recording_id bigint, segment_idx bigint, start_ms bigint, end_ms bigint"


def table(spark, rows, schema):
    return spark.createDataFrame([(1, *r) for r in rows], schema)


def test_touching_and_empty_intervals_do_not_overlap(spark):
    turns = table(spark, [(0, "A", 0, 1000)], TURNS)
    items = table(spark, [(0, 1000, 2000), (1, 500, 500), (2, 999, 1001)], ITEMS)
    assert [(r.segment_idx, r.overlap_ms) for r in sp.overlap_join(items, turns).collect()] == [(2, 1)]


def test_tie_goes_to_the_earlier_turn(spark):
    turns = table(spark, [(1, "B", 1000, 2000), (0, "A", 0, 1000)], TURNS)
    items = table(spark, [(0, 0, 2000)], ITEMS)
    assert sp.dominant_speaker(items, turns).first()["speaker"] == "A"


def test_nearest_tie_goes_to_the_smaller_start(spark):
    turns = table(spark, [(0, "A", 0, 14), (1, "B", 4, 6)], TURNS)
    items = table(spark, [(0, 6, 6)], ITEMS)
    assert sp.nearest_speaker(items, turns).first()["speaker"] == "A"
    named = sp.assign_speakers(items, turns, fill_nearest=True).first()
    assert (named.speaker, named.speaker_by) == ("A", "nearest")
    assert sp.assign_speakers(items, turns).first()["speaker"] is None


def test_missing_times_and_empty_names(spark):
    items = table(spark, [(0, None, 50), (1, 10, None)], ITEMS)
    assert [(r.segment_idx, r.end_ms) for r in sp.known_times(items).collect()] == [(1, 10)]
    assert [(r.start_ms, r.end_ms) for r in sp.defaulted_times(items).orderBy("segment_idx").collect()] == [(0, 50), (10, 0)]
    turns = table(spark, [(0, "", 0, 5)], TURNS)
    assert sp.nearest_speaker(table(spark, [(0, 9, 9)], ITEMS), turns).count() == 0


@pytest.mark.parametrize("bucket", [7, 50, 10_000])
def test_bucketed_joins_equal_brute_force(spark, bucket):
    rng = random.Random(bucket)
    turns = [(i, rng.choice("ABC"), s, s + rng.randint(0, 60)) for i in range(60) for s in [rng.randint(0, 900)]]
    items = [(i, s, s + rng.randint(0, 30)) for i in range(120) for s in [rng.randint(0, 1000)]]
    t, i = table(spark, turns, TURNS), table(spark, items, ITEMS)
    pairs = {(r.segment_idx, r.turn_idx): r.overlap_ms for r in sp.overlap_join(i, t, bucket_ms=bucket).collect()}
    want = {}
    for item, s, e in items:
        for turn, _, ts, te in turns:
            if min(e, te) > max(s, ts):
                want[item, turn] = min(e, te) - max(s, ts)
    assert pairs == want
    near = {r.segment_idx: r.speaker for r in sp.nearest_speaker(i, t, bucket_ms=bucket).collect()}
    for item, s, e in items:
        best = min(turns, key=lambda x: (abs(x[2] + x[3] - s - e), x[2], x[0]))
        assert near[item] == best[1]


def test_clusters(spark):
    rows = [(7, i, [float(i % 2) * 10 + i * 0.01, 1.0]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "recording_id bigint, vec_id bigint, embedding array<float>")
    found = {r.vec_id: r.speaker for r in sp.cluster_speakers(vectors, low=2, high=4).collect()}
    assert len(set(found.values())) == 2 and found[0] == found[2] != found[1] and found[0] == "SPEAKER_00"
    assert sp.cluster_speakers(vectors, num=3).select("speaker").distinct().count() == 3
    with pytest.raises(ValueError):
        sp.cluster_speakers(vectors, low=5, high=3)


def test_bounds_are_those_of_the_recording(spark):
    """Every recording has its own number of voices, and bounds that its evidence cannot move."""
    import numpy as np

    r = np.random.default_rng(5)
    rows = []
    for recording, (voices, low, high) in enumerate([(3, 1, 6), (1, 1, 4), (4, 2, 2), (2, 3, 5), (2, 2, 2)]):
        centres = r.normal(0, 30, (voices, 5))
        rows += [(recording, len(rows) + i, (centres[i % voices] + r.normal(0, 1, 5)).tolist(), low, high) for i in range(60)]
    rows += [(9, 1000, [1.0] * 5, 2, 3), (4, 1001, None, 2, 2)]
    vectors = spark.createDataFrame(rows, "recording_id int, vec_id bigint, embedding array<double>, min_speakers int, max_speakers int")
    got = sp.cluster_speakers(vectors.repartition(6)).collect()
    voices = {k: {r.speaker for r in got if r.recording_id == k and r.embedding is not None} for k in (0, 1, 2, 3, 4, 9)}
    assert {k: len(v) for k, v in voices.items() if k != 3} == {0: 3, 1: 1, 2: 2, 4: 2, 9: 1} and 3 <= len(voices[3]) <= 5
    assert [r.speaker for r in got if r.embedding is None] == [None] and len(got) == len(rows)
    for k in (0, 1, 2, 3, 4):
        mine = [r for r in got if r.recording_id == k and r.embedding is not None]
        names = sorted({r.speaker for r in mine})
        assert names == [f"SPEAKER_{i:02d}" for i in range(len(names))]


def test_long_recordings_are_clustered_by_cells(monkeypatch, spark):
    """Far more vectors than points are allowed: the voices are found all the same, and no task holds more points."""
    import numpy as np

    monkeypatch.setattr(sp, "MOST_POINTS", 64)
    r = np.random.default_rng(8)
    centres = r.normal(0, 20, (3, 6))
    rows = [("long", i, (centres[i % 3] + r.normal(0, 1, 6)).tolist()) for i in range(1500)]
    vectors = spark.createDataFrame(rows, "recording_id string, vec_id bigint, embedding array<double>")
    got = {x.vec_id: x.speaker for x in sp.cluster_speakers(vectors, low=1, high=6).collect()}
    assert [got[i] for i in range(3)] == ["SPEAKER_00", "SPEAKER_01", "SPEAKER_02"]
    assert all(got[i] == got[i % 3] for i in range(1500))


def test_merges_by_chains_are_wards(spark):
    """Heights of all merges, against looking at every pair in every step."""
    import numpy as np

    r = np.random.default_rng(2)
    points, weights = r.normal(0, 1, (25, 3)), r.integers(1, 5, 25).astype(float)
    groups = [(w, p * w) for p, w in zip(points, weights)]
    heights = []
    while len(groups) > 1:
        cost = lambda a, b: a[0] * b[0] / (a[0] + b[0]) * ((a[1] / a[0] - b[1] / b[0]) ** 2).sum()
        h, i, j = min((cost(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        heights.append(h)
        joined = (groups[i][0] + groups[j][0], groups[i][1] + groups[j][1])
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [joined]
    assert np.allclose([h for h, _, _ in sp.ward_merges(points, weights)], heights)
