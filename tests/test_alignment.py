"""Alignment end to end on synthetic emissions, and the filling of missing times."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechloom.operators import alignment as al, speakers as sp, words as wd, writers as wr

SIGNS = ["<pad>", *"abcdefghiklmnoprstuw", "|"]
DICTIONARY = {s: i for i, s in enumerate(SIGNS)}


def model_for(n_frames):
    def model(batches):
        for batch in batches:
            out = []
            for text in batch["text"]:
                logits = np.full((n_frames, len(SIGNS)), -5.0, dtype=np.float32)
                logits[:, 0] = -1.0
                per = n_frames // (len(text) + 1)
                for i, c in enumerate(text):
                    if c in DICTIONARY:
                        near = slice(max(0, (i + 1) * per - per // 2), (i + 1) * per + per // 2)
                        logits[near, DICTIONARY[c]] = 2.0
                        logits[near, 0] = -3.0
                out.append(logits.ravel())
            yield batch.assign(n_frames=n_frames, n_classes=len(SIGNS), logits=out)

    return model


def run(spark, text, n_frames=100, method="nearest", start=0, audio=5000):
    rows = [(1, 0, "en", text, start, start + 5000, audio)]
    table = spark.createDataFrame(rows, "recording_id bigint, segment_idx bigint, lang string, text string, "
                                        "start_ms bigint, end_ms bigint, audio_ms bigint")
    sentences, words = al.align_corpus(table, model_for(n_frames), DICTIONARY, method)
    return sentences.orderBy("part").collect(), words.orderBy("sentence_idx", "word_idx").collect()


@pytest.mark.parametrize("text, n_frames", [
    ("a red door", 100), ("room 17 is free", 100), ("near 60k people", 100), ("808 909", 100), ("some 12 ships", 100),
    ("die rate liegt bei 3,7 im mittel", 200),
])
def test_every_word_gets_times_in_order(spark, text, n_frames):
    sentences, words = run(spark, text, n_frames)
    assert [w.word for w in words] == text.split(" ")
    for w in words:
        assert w.start_ms is not None and w.end_ms is not None and w.score is not None
        assert 0 <= w.start_ms <= w.end_ms <= 5000
    starts = [w.start_ms for w in words]
    assert starts == sorted(starts)
    assert len(sentences) == 1 and sentences[0].fail_reason is None
    assert sentences[0].start_ms == starts[0]


def test_characters_lie_at_their_peaks():
    frames, tokens = 60, np.array([3, 1, 2])
    logits = np.zeros((frames, 4))
    logits[:, 0] = 9.0
    peaks = [10, 31, 47]
    for t, k in zip(peaks, tokens):
        logits[t, [0, k]] = -9.0, 9.0
    logp = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    token, frame, prob = al.best_path(logp.astype(np.float32), tokens, 0)
    assert [int(frame[np.flatnonzero(token == k)[0]]) for k in range(3)] == peaks
    assert prob.min() > 0.99 and frame[-1] == 47


def test_ignore_keeps_known_times(spark):
    sentences, words = run(spark, "the 99 cats", method="ignore")
    assert len(words) == 3 and words[0].start_ms is not None and words[2].end_ms is not None
    assert sentences[0].start_ms is not None and sentences[0].end_ms is not None


def test_segments_that_cannot_be_aligned_pass_through(spark):
    for kwargs, reason in (({"text": "  "}, "no_characters"), ({"text": "cat", "start": 9000}, "beyond_audio"),
                           ({"text": "the cats", "n_frames": 5}, "no_path")):
        sentences, words = run(spark, **kwargs)
        assert [s.fail_reason for s in sentences] == [reason] and words == []


def test_best_path_is_the_best(spark):
    rng = np.random.default_rng(4)
    for _ in range(30):
        frames, tokens = int(rng.integers(3, 7)), rng.integers(1, 4, int(rng.integers(1, 3)))
        logp = np.log(rng.dirichlet(np.ones(4), frames)).astype(np.float32)
        path = al.best_path(logp, tokens, 0)
        if path is None:
            continue
        token, frame, prob = path
        assert (np.diff(token) >= 0).all() and (np.diff(frame) == 1).all()
        assert token[0] == 0 and token[-1] == len(tokens) - 1

        # Cost of entering the tokens at given frames and staying on blanks otherwise, up to the same last frame.
        def value(entries, end):
            return sum(logp[t, tokens[entries.index(t)]] if t in entries else logp[t, 0] for t in range(end + 1))

        end = int(frame[-1])
        mine = tuple(int(frame[np.flatnonzero(token == k)[0]]) for k in range(len(tokens)))
        others = itertools.combinations(range(end + 1), len(tokens))
        free = [e for e in others if e[0] <= frames - len(tokens)]
        assert value(list(mine), end) >= max(value(list(e), end) for e in free) - 1e-4
    assert al.best_path(np.zeros((3, 2), dtype=np.float32), np.ones(5, dtype=np.int64), 0) is None


def test_aligned_corpus_to_files(spark):
    """Align, assign speakers to sentences and words, and write."""
    rows = [("r", 0, "en", "the cat. was it", 0, 5000, 9000), ("r", 1, "en", "", 5000, 6000, 9000),
            ("r", 2, "en", "a 43 k", 6000, 8000, 9000)]
    table = spark.createDataFrame(rows, "recording_id string, segment_idx bigint, lang string, text string, "
                                        "start_ms bigint, end_ms bigint, audio_ms bigint")
    sentences, words = al.align_corpus(table, model_for(100), DICTIONARY)
    turns = spark.createDataFrame([("r", 0, "A", 0, 5500), ("r", 1, "B", 5500, 9000)],
                                  "recording_id string, turn_idx bigint, speaker string, start_ms bigint, end_ms bigint")
    sentences = sp.assign_speakers(sentences, turns, ("segment_idx", "part"))
    words = sp.assign_speakers(words, turns, ("segment_idx", "part", "sentence_idx", "word_idx"))
    nested = al.aligned_segments(sentences, words, F.lit("en")).orderBy("segment_idx").cache()
    got = nested.collect()
    assert [r.segment_idx for r in got] == list(range(len(got)))
    assert [(r.text, r.speaker) for r in got] == [("the cat.", "A"), ("was it", "A"), ("", "A"), ("a 43 k", "B")]
    assert [[w.word for w in r.words] for r in got] == [["the", "cat."], ["was", "it"], [], ["a", "43", "k"]]
    doc = json.loads("".join(r.line for r in wr.json_lines(nested).orderBy("ord").collect()))
    assert [w["speaker"] for w in doc["word_segments"]] == ["A"] * 4 + ["B"] * 3
    assert all({"word", "start", "end", "score"} <= set(w) for w in doc["word_segments"])
    assert len(wr.WRITERS["srt"](nested).collect()) == 3 and len(wr.txt_lines(nested).collect()) == 4


def test_unknown_model_kind(spark):
    with pytest.raises(NotImplementedError):
        al.emit_with(spark.range(1), None, kind="other")


def filled(spark, values, method):
    table = spark.createDataFrame([(1, 1, i, v) for i, v in enumerate(values)],
                                  "recording_id bigint, segment_idx bigint, pos int, v bigint")
    out = table.withColumn("v", wd.interpolated("v", "pos", wd.SEGMENT, method)).orderBy("pos").collect()
    return [r.v for r in out]


@pytest.mark.parametrize("values, nearest, linear", [
    ([None, 1, None, None, 4, None], [1, 1, 1, 4, 4, 4], [1, 1, 2, 3, 4, 4]),
    ([1, None, 3, None, 5], [1, 1, 3, 3, 5], [1, 2, 3, 4, 5]),
    ([None, 7, None], [7, 7, 7], [7, 7, 7]),
    ([None, None], [None, None], [None, None]),
])
def test_interpolation(spark, values, nearest, linear):
    assert filled(spark, values, "nearest") == nearest
    assert filled(spark, values, "linear") == linear
    assert filled(spark, values, "ignore") == values


def test_words_without_times_are_filled_only_in_mixed_sentences(spark):
    rows = [(1, 0, 0, i, s, e) for i, (s, e) in enumerate([(100, 300), (None, None), (600, 900)])]
    rows += [(1, 1, 0, 0, None, None), (1, 2, 0, 0, 5, None), (1, 2, 0, 1, 9, 10)]
    table = spark.createDataFrame(rows, "recording_id bigint, segment_idx bigint, sentence_idx int, word_idx int, "
                                        "start_ms bigint, end_ms bigint")
    got = wd.interpolate_words(table, [*wd.SEGMENT, "sentence_idx"]).orderBy("segment_idx", "word_idx").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(100, 300), (100, 300), (600, 900), (None, None), (5, None), (9, 10)]


def test_equal_sentences_merge(spark):
    rows = [(1, 0, 0, "A.", 0, 5, -0.5), (1, 0, 1, "B.", 0, 5, -0.7), (1, 0, 2, "C.", 5, 9, -0.1), (1, 0, 3, "D.", None, None, 0.0)]
    table = spark.createDataFrame(rows, "recording_id bigint, segment_idx bigint, sentence_idx int, text string, "
                                        "start_ms bigint, end_ms bigint, avg_logprob double")
    got = wd.merge_equal_sentences(table).orderBy("first_idx").collect()
    assert [(r.text, r.members, r.avg_logprob) for r in got] == [("A. B.", [0, 1], -0.5), ("C.", [2], -0.1)]
    tight = wd.merge_equal_sentences(table, F.lit("ja")).orderBy("first_idx").first()
    assert tight.text == "A.B."


def test_double_blanks_and_abbreviations(spark):
    table = spark.createDataFrame([(1, 0, " a  b. Dr. C is in!  Yes ")], "recording_id bigint, segment_idx bigint, text string")
    assert [r.sentence for r in wd.spans(table).orderBy("sentence_idx").collect()] == ["a  b.", "Dr. C is in!", "Yes"]
    assert [(r.s_start, r.s_end) for r in wd.spans(table).orderBy("sentence_idx").collect()] == [(1, 6), (7, 19), (21, 24)]
    index = wd.word_index(table.withColumn("lang", F.lit("en"))).orderBy("cdx").collect()
    assert [r.word_idx for r in index][:6] == [0, 0, 1, 2, 2, 2]
    tight = wd.word_index(table.withColumn("lang", F.lit("zh"))).orderBy("cdx").collect()
    assert [r.word_idx for r in tight] == list(range(25))


def plain_path(logp, tokens, blank):
    """The search over the whole matrix of frames and tokens, one cell at a time."""
    frames, n = len(logp), len(tokens)
    if not 0 < n <= frames:
        return None
    score = np.full((frames + 1, n + 1), -np.inf, dtype=np.float32)
    score[:, 0] = np.concatenate(([0], np.cumsum(logp[:, blank], dtype=np.float32)))
    score[frames + 1 - n:, 0] = np.inf
    for t in range(frames):
        for j in range(1, n + 1):
            score[t + 1, j] = max(score[t, j - 1] + logp[t, tokens[j - 1]], score[t, j] + logp[t, blank])
    t, j, steps = int(score[1:, n].argmax()) + 1, n, []
    while j > 0 and t > 0:
        t -= 1
        entered = score[t, j - 1] + logp[t, tokens[j - 1]] > score[t, j] + logp[t, blank]
        steps.append((j - 1, t, float(np.exp(np.float64(logp[t, tokens[j - 1] if entered else blank])))))
        j -= entered
    return steps[::-1] if j == 0 else None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batched_paths_are_those_of_the_whole_matrix(monkeypatch, seed):
    from speechloom.operators import paths

    r = np.random.default_rng(seed)
    monkeypatch.setattr(paths, "GROUP_CELLS", int(r.choice([1, 40, 1 << 16])))
    segments = []
    for _ in range(40):
        frames, classes = int(r.integers(0, 40)), int(r.integers(3, 7))
        logp = (r.integers(-40, 0, (frames, classes)) / 8).astype(np.float32)  # many ties
        segments.append(paths.Segment(logp, r.integers(0, classes, int(r.integers(0, 12))), int(r.integers(0, classes))))
    for s, got in zip(segments, paths.best_paths(segments), strict=True):
        want = plain_path(s.logp, s.tokens, s.blank)
        if want is None:
            assert got is None
        else:
            assert list(zip(got.token.tolist(), got.frame.tolist(), got.prob.tolist())) == want


@pytest.mark.parametrize("window", [5, 8, 16])
def test_paths_in_a_window_are_those_of_the_whole_matrix(monkeypatch, window):
    """Clear emissions are settled in the window; flat ones are found out and searched whole."""
    from speechloom.operators import paths

    r = np.random.default_rng(window)
    monkeypatch.setattr(paths, "WINDOWS", (window,))
    segments = []
    for clear in (True, False) * 10:
        count = int(r.integers(1, 40))
        logp = (r.integers(-40, 0, (3 * count + 2, 6)) / 8).astype(np.float32)
        tokens, blank = r.integers(0, 5, count), 5
        if clear:
            logp[:] = -20.0
            logp[:, blank] = -0.5
            logp[3 * np.arange(count) + 1, tokens] = -0.25
            logp[3 * np.arange(count) + 1, blank] = -30.0
        segments.append(paths.Segment(logp, tokens, blank))
    segments.append(paths.Segment(np.full((90, 6), -np.inf, np.float32), r.integers(0, 5, 30), 5))
    windowed = paths._windowed(segments, window)
    assert all(p is not None for p in windowed[:20:2]) and any(p is None for p in windowed[1:20:2])
    for s, got in zip(segments[:-1], paths.best_paths(segments)[:-1], strict=True):
        assert list(zip(got.token.tolist(), got.frame.tolist(), got.prob.tolist())) == plain_path(s.logp, s.tokens, s.blank)
    assert windowed[-1] is None


def test_languages_side_by_side(spark):
    """Each language has its own characters and blank; what no voice speaks is passed through with its log-probability."""
    def voice(signs, kind):
        dictionary = {c: i for i, c in enumerate(signs)}
        blank = dictionary.get("[pad]", 0)

        def model(batches):
            for batch in batches:
                out, frames = [], []
                for text, ids, at in zip(batch["text"], batch["token_ids"], batch["token_cdx"]):
                    logits = np.full((2 * len(text) + 1, len(signs)), -9.0, dtype=np.float32)
                    logits[:, blank] = 0.0
                    for i, c in zip(ids, at):
                        logits[2 * c + 1, [blank, max(i, 1)]] = -9.0, 5.0
                    out.append(logits.ravel())
                    frames.append(len(logits))
                yield batch.assign(n_frames=frames, n_classes=len(signs), logits=out)

        return al.Voice(model, dictionary)

    voices = {"en": voice(["<pad>", *"abcdefghijklmnopqrstuvwxyz", "|"], 0), "zh": voice([*"你好吗", "[pad]"], 1)}
    rows = [("r", 0, "en", "hi there. you", 0, 2600, 9000, -0.5), ("r", 1, "zh", "你好x吗", 2600, 3500, 9000, -0.25), ("r", 2, "fr", "oui", 3500, 4000, 9000, None),
            ("r", 3, None, "no", 4000, 5000, 9000, -1.0), ("r", 4, "en", None, 5000, 6000, 9000, -2.0), ("r", 5, "en", "hi", None, 6500, 9000, -3.0)]
    table = spark.createDataFrame(rows, "recording_id string, segment_idx bigint, lang string, text string, start_ms bigint, end_ms bigint, "
                                        "audio_ms bigint, avg_logprob double").repartition(3)
    sentences, words = al.align_corpus(table, voices, chars=True)
    got = {(s.segment_idx, s.part): s for s in sentences.collect()}
    assert [(k, s.fail_reason, s.avg_logprob) for k, s in sorted(got.items())] == [
        ((0, 0), None, -0.5), ((0, 1), None, -0.5), ((1, 0), None, -0.25), ((2, 0), "no_model", None), ((3, 0), "no_model", -1.0), ((4, 0), "no_characters", -2.0), ((5, 0), "no_times", -3.0)]
    assert [c.char for c in got[0, 1].chars] == list("you") and all(c.start_ms is not None for c in got[0, 1].chars)
    assert [(c.char, c.start_ms) for c in got[1, 0].chars] == [("你", 2700), ("好", 2900), ("x", 3100), ("吗", 3300)]
    assert got[2, 0].chars == [] and got[4, 0].text is None
    assert [w.word for w in words.filter("segment_idx = 1").orderBy("word_idx").collect()] == list("你好x吗")
    nested = al.aligned_segments(sentences, words)
    doc = json.loads("".join(r.line for r in wr.json_lines(nested.withColumn("lang", F.lit("en"))).orderBy("ord").collect()))
    assert [s.get("avg_logprob") for s in doc["segments"]] == [-0.5, -0.5, -0.25, None, -1.0, -2.0, -3.0]
    assert [c["char"] for c in doc["segments"][2]["chars"]] == list("你好x吗")
