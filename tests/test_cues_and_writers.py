from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from speechloom.functions import text as tx, time as tm
from speechloom.operators import cues as cu, subtitles as sb, writers as wr
from speechloom.params import CueLimits, SplitLimits
from speechloom.sources import recordings

NESTED = ("recording_id string, segment_idx bigint, speaker string, lang string, text string, start_ms bigint, "
          "end_ms bigint, words array<struct<word:string,start_ms:bigint,end_ms:bigint>>")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("seconds, short, full", [
    (0.0, "00:00.000", "00:00:00,000"), (59.9996, "01:00.000", "00:01:00,000"), (3600.0, "01:00:00.000", "01:00:00,000"),
    (3599.9995, "01:00:00.000", "01:00:00,000"), (1.0005, "00:01.000", "00:00:01,000"), (400000.5, "111:06:40.500", "111:06:40,500"),
])
def test_timestamps(spark, seconds, short, full):
    assert one(spark, tm.format_seconds(F.lit(seconds))) == short
    assert one(spark, tm.format_seconds(F.lit(seconds), True, ",")) == full


def test_bad_times_raise(spark):
    with pytest.raises(Exception, match="non-negative"):
        one(spark, tm.format_ms(F.lit(-1)))
    with pytest.raises(Exception, match="16000"):
        one(spark, tm.samples_to_seconds(F.lit(1), F.lit(8000)))


def test_text_helpers(spark):
    assert one(spark, tx.strip(F.lit("  a b\t\n"))) == "a b"
    assert one(spark, tx.cue_text(F.lit(" a --> b "))) == "a -> b"
    assert one(spark, tx.underline(F.lit("\nword"))) == "\n<u>word</u>"
    assert one(spark, tm.seconds_text(F.lit(10_000_000_000))) == "10000000.0"
    assert one(spark, tm.seconds_text(F.lit(1))) == "0.001"
    assert one(spark, recordings.recording_id(F.lit("/a/b.c/show.final.wav"))) == "show.final"
    assert one(spark, recordings.recording_id(F.lit("/a/.hidden"))) == ".hidden"


def nested(spark):
    return spark.createDataFrame([
        ("r", 0, "S", "en", " Hi there ", 0, 2000, [("Hi", 100, 400), ("there", None, None)]),
        ("r", 1, None, "en", "no words", 2000, 3000, []),
        ("r", 2, None, "en", "x\ty", 3000, 3_700_000, [("x", None, None), ("y", None, None)]),
    ], NESTED)


def lines(df):
    return [r.line for r in df.orderBy("recording_id", "ord").collect()]


def test_formats(spark):
    table = nested(spark)
    assert lines(wr.txt_lines(table)) == ["[S]: Hi there", "no words", "x\ty"]
    assert lines(wr.tsv_lines(table)) == ["start\tend\ttext", "0\t2000\tHi there", "2000\t3000\tno words", "3000\t3700000\tx y"]
    assert lines(wr.label_lines(table)) == ["0.0\t2.0\t[[S]]Hi there", "2.0\t3.0\tno words", "3.0\t3700.0\tx y"]
    assert lines(wr.WRITERS["srt"](table)) == [
        "1\n00:00:00,100 --> 00:00:00,400\n[S]: Hi there\n", "2\n00:00:03,000 --> 01:01:40,000\nx y\n"]
    assert lines(wr.WRITERS["vtt"](table)) == [
        "WEBVTT\n", "00:00.100 --> 00:00.400\n[S]: Hi there\n", "00:03.000 --> 01:01:40.000\nx y\n"]
    with pytest.raises(ValueError):
        wr.writers_for("doc")
    assert "aud" not in wr.writers_for("all")


def test_json_document(spark):
    vectors = spark.createDataFrame([("r", "S", [0.5, 1.0])], "recording_id string, speaker string, embedding array<float>")
    doc = json.loads("".join(lines(wr.json_lines(nested(spark), vectors))))
    assert doc["segments"][0]["words"] == [{"word": "Hi", "start": 0.1, "end": 0.4}, {"word": "there"}]
    assert "speaker" not in doc["segments"][1] and len(doc["word_segments"]) == 4
    assert doc["language"] == "en" and doc["speaker_embeddings"] == {"S": [0.5, 1.0]}


def test_files_are_written_in_order(spark, tmp_path):
    table = nested(spark).unionByName(nested(spark).withColumn("recording_id", F.lit("q")))
    wr.write_formats(table, str(tmp_path / "out"), "all")
    for name in wr.WRITERS:
        for rec in ("q", "r"):
            files = sorted(Path(tmp_path, "out", f"format={name}", f"recording_id={rec}").glob("*.txt"))
            text = "".join(f.read_text() for f in files)
            want = lines(wr.WRITERS[name](table.filter(F.col("recording_id") == rec)))
            assert text == "".join(line + "\n" for line in want)


def test_highlighting(spark):
    table = spark.createDataFrame([("r", 0, None, "en", "a b c", 0, 900, [("a", 0, 100), ("b", None, None), ("c", 300, 400)])], NESTED)
    got = cu.highlight_cues(table).orderBy("step").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [
        (0, 100, "<u>a</u> b c"), (100, 300, "a b c"), (300, 400, "a b <u>c</u>")]


def test_line_breaks_inside_a_segment(spark):
    table = spark.createDataFrame([("r", 0, None, "en", "", 0, 9, [("abc", None, None), ("def", None, None), ("g", None, None)])], NESTED)
    assert cu.cues_by_segment(table, CueLimits(max_line_width=6)).first().text == "abc def \ng"
    assert cu.cues_by_segment(table.withColumn("lang", F.lit("zh")), CueLimits(max_line_width=6)).first().text == "abcdef\ng"


def test_estimated_times(spark):
    rows = [(1, 0, i, w, s, e, 5000) for i, (w, s, e) in enumerate([
        ("ab", None, None), ("cd", 1000, 1500), ("ef", None, None), ("gh", None, None), ("ij", None, None)])]
    rows += [(1, 1, 0, "ab", None, None, None), (1, 1, 1, "cdef", None, None, None), (1, 1, 2, "g", None, None, None)]
    rows += [(1, 2, 0, "ab", None, None, 4000), (1, 2, 1, "cd", None, None, 4000)]
    table = spark.createDataFrame(rows, "recording_id bigint, segment_idx bigint, pos int, word string, start_ms bigint, "
                                        "end_ms bigint, next_start_ms bigint")
    got = [(r.start_ms, r.end_ms) for r in sb.estimate_word_times(table).orderBy("segment_idx", "pos").collect()]
    assert got == [(500, 1000), (1000, 1500), (1500, 4500), (4500, 5000), (5000, 5000),
                   (0, 0), (0, 1000), (1000, 1250), (3000, 3500), (3500, 4000)]


def test_split_at_comma_conjunction_and_width(spark):
    def cut(text, lang="en"):
        table = spark.createDataFrame([(text, lang)], "text string, lang string").withColumn(
            "words", F.transform(F.split("text", " "), lambda w: F.struct(w.alias("word"))))
        return sb.with_split_points(table, True).first().splits

    left, right = "aaaaaaaaa bbbbbbbbb ccccccccc", "dddddddddddd eeeeeeeeeeee ffffffffff"
    assert cut(f"{left} xx, {right}") == [3]
    assert cut(f"{left} xx and {right}") == [3]
    short = "aaaa bbbb cccc dddd eeee ffff"
    long = f"{short} gggg und {right} {right}"
    assert cut(long, "de")[0] == 6
    assert cut(long)[0] == 4
    assert cut("a b c") == []
    assert cut(" ".join(["abcdefghi"] * 6)) == [2]


def test_batches_progress_and_quality(spark):
    from speechloom.operators import progress as pg, quality as ql

    chunks = spark.createDataFrame([("r", i) for i in range(20)], "recording_id string, chunk_idx bigint")
    assert [r.batch for r in ql.batch_of(chunks).orderBy("chunk_idx").collect()] == [i // 8 for i in range(20)]
    events = spark.createDataFrame(
        [("r", "segmentation", 1, 1, 2), ("r", "segmentation", 2, 2, 2), ("r", "embeddings", 3, 0, 4), ("r", "other", 4, 1, 3),
         ("r", "embeddings", 5, 9, 4), ("r", "embeddings", 6, 1, 0)],
        "recording_id string, step string, seq bigint, completed bigint, total bigint")
    got = pg.monotone_progress(events, ["seq"], F.floor(F.col("seq") / 2)).orderBy(F.col("seq").asc_nulls_last()).collect()
    assert [r.percent for r in got] == [25.0, 50.0, 99.0, 100.0]
    rows = spark.createDataFrame([("a" * 900, -0.1, 0.9), ("quick brown fox", -2.0, 0.9), ("quick brown fox", -0.2, 0.9)],
                                 "text string, avg_logprob double, no_speech_prob double")
    assert [(r.failed, r.silence) for r in ql.quality_gate(rows).collect()] == [(True, False), (True, True), (False, False)]


def test_unaligned_transcripts_have_cues(spark):
    """A null word list shows the segment's text, an empty one shows nothing; the first segment decides."""
    rows = [("n", 0, "S", "en", "a --> b", 0, 900, None), ("n", 1, None, "en", "c", 1000, 2000, None),
            ("e", 0, "S", "en", "lost", 0, 900, []), ("e", 1, "S", "en", "d", 1000, 2000, [("d", 1000, 1500)])]
    table = spark.createDataFrame(rows, NESTED)
    got = [(r.recording_id, r.cue_idx, r.text) for r in cu.transcript_cues(table).orderBy("recording_id", "cue_idx").collect()]
    assert got == [("e", 1, "[S]: d"), ("n", 0, "[S]: a -> b"), ("n", 1, "c")]
    made = {(r.format, r.recording_id): r.n for r in wr.fan_out(table).groupBy("format", "recording_id").agg(F.count("*").alias("n")).collect()}
    assert made["srt", "n"] == 2 and made["vtt", "n"] == 3 and made["json", "n"] > 0


def test_highlighting_composes_with_both_layouts(spark):
    words = [("abc", 0, 100), ("def", 100, 200), ("g", None, None), ("hij", 300, 400)]
    table = spark.createDataFrame([("r", 0, None, "en", "", 0, 900, words)], NESTED)
    for limits in (CueLimits(max_line_width=6), CueLimits(max_line_width=6, max_line_count=5)):
        texts = [r.text for r in cu.transcript_cues(table, limits, highlight=True).orderBy("cue_idx", "step").collect()]
        assert texts == ["<u>abc</u> def \ng hij", "abc <u>def</u> \ng hij", "abc def \ng hij", "abc def \ng <u>hij</u>"]
    assert cu.cues_by_segment(table.withColumn("lang", F.lit("zh"))).first().text == "abcdefghij"


def test_conjunction_lists_are_a_parameter(spark):
    words = [(w, None, None) for w in ("aaaaaaaaaa bbbbbbbbbb cccccccccc zzz eeeeeeeeee ffffffffff gggggggggg hhhh").split()]
    table = spark.createDataFrame([("r", 0, None, "xx", "", 0, 900, words)], NESTED)
    splits = lambda **lists: sb.with_split_points(table, True, SplitLimits(100, 20), **lists).first().splits
    assert splits(lists={"xx": ["zzz"]}) == [2] and splits() == []
