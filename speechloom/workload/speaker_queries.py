"""Speaker assignment on the conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechloom.operators import speakers as sp
from speechloom.sources import corpus
from speechloom.workload.registry import query

WORD = ("segment_idx", "pos")


def _inputs(spark, sf_dir):
    segments = corpus.utterances(spark, sf_dir)
    return segments, corpus.speaker_turns(segments)


def _timed_words(segments):
    return sp.known_times(corpus.null_words(corpus.words(segments)))


@query("turn_unpack", """
    SELECT recording_id, turn_idx, track, speaker, start_ms, end_ms FROM speaker_turns""", using=("speaker_turns",))
def turn_unpack(spark, sf_dir):
    _, turns = _inputs(spark, sf_dir)
    tracks = turns.select("recording_id", "turn_idx", "track", "speaker",
                          F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end")).alias("segment"))
    return sp.unpack_turns(tracks)


@query("overlap_join", "SELECT * FROM turn_pairs", using=("turn_pairs",))
def overlap_join(spark, sf_dir):
    segments, turns = _inputs(spark, sf_dir)
    return sp.overlap_join(segments, turns)


@query("dominant_speaker_seg", "SELECT * FROM segment_speakers", using=("segment_speakers",))
def dominant_speaker_seg(spark, sf_dir):
    segments, turns = _inputs(spark, sf_dir)
    return sp.dominant_speaker(segments, turns)


@query("dominant_speaker_word", "SELECT * FROM word_speakers", using=("word_speakers",))
def dominant_speaker_word(spark, sf_dir):
    segments, turns = _inputs(spark, sf_dir)
    return sp.dominant_speaker(_timed_words(segments), turns, WORD)


@query("nearest_speaker", "SELECT * FROM nearest", using=("nearest",))
def nearest_speaker(spark, sf_dir):
    segments, turns = _inputs(spark, sf_dir)
    timed = _timed_words(segments)
    far = timed.join(sp.dominant_speaker(timed, turns, WORD), ["recording_id", *WORD], "left_anti")
    return sp.nearest_speaker(far, turns, WORD)


@query("speaker_cascade", """
    SELECT w.recording_id, w.segment_idx, w.pos, w.word, coalesce(o.speaker, n.speaker) AS speaker,
      CASE WHEN o.speaker IS NOT NULL THEN 'overlap' WHEN n.speaker IS NOT NULL THEN 'nearest' END AS speaker_by
    FROM null_words w LEFT JOIN word_speakers o USING (recording_id, segment_idx, pos)
      LEFT JOIN nearest n USING (recording_id, segment_idx, pos)""", using=("null_words", "word_speakers", "nearest"))
def speaker_cascade(spark, sf_dir):
    segments, turns = _inputs(spark, sf_dir)
    words = corpus.null_words(corpus.words(segments))
    return sp.assign_speakers(words, turns, WORD, fill_nearest=True).select(
        "recording_id", *WORD, "word", "speaker", "speaker_by")


@query("words_per_speaker", """
    SELECT recording_id, speaker, count(*) AS n_words FROM word_speakers GROUP BY ALL""", using=("word_speakers",))
def words_per_speaker(spark, sf_dir):
    """How many words each speaker of a recording says, speakers decided by overlap."""
    segments, turns = _inputs(spark, sf_dir)
    return sp.dominant_speaker(_timed_words(segments), turns, WORD).groupBy("recording_id", "speaker").agg(
        F.count("*").alias("n_words"))


@query("attach_embeddings", """
    WITH one AS (SELECT label, max(len(embedding)) AS dims, avg(embedding[1]::DOUBLE) AS e FROM embeddings GROUP BY label)
    SELECT u.recording_id, u.segment_idx, u.speaker, one.dims, CAST(round_even(one.e * 1000000, 0) AS BIGINT) AS first_micro
    FROM utterances u LEFT JOIN one ON one.label = (u.recording_id * 2 + (u.speaker = 'user')::INT) % 11""",
    using=("utterances",))
def attach_embeddings(spark, sf_dir):
    """Every speaker gets the centre of all vectors of one label; some labels have none."""
    segments, _ = _inputs(spark, sf_dir)
    parts = corpus.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    centres = parts.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda d: d["x"]).alias("embedding"))
    label = (F.col("recording_id") * 2 + (F.col("speaker") == "user").cast("int")) % 11
    pairs = segments.select("recording_id", "speaker").distinct().withColumn("label", label.cast("int")).join(
        centres, "label").drop("label")
    return sp.attach_embeddings(segments, pairs).select(
        "recording_id", "segment_idx", "speaker", F.size("embedding").cast("bigint").alias("dims"),
        F.rint(F.element_at("embedding", 1).cast("double") * 1000000).cast("bigint").alias("first_micro"),
    ).withColumn("dims", F.when(F.col("dims") >= 0, F.col("dims")))


@query("segment_speakers_default", """
    WITH s AS (
      SELECT recording_id, segment_idx, CASE WHEN segment_idx % 5 <> 2 THEN start_ms END AS start_ms, CASE WHEN segment_idx % 7 <> 3 THEN end_ms END AS end_ms
      FROM utterances),
    d AS (SELECT recording_id, segment_idx, coalesce(start_ms, 0) AS s, coalesce(end_ms, 0) AS e FROM s),
    sums AS (
      SELECT d.recording_id, d.segment_idx, t.speaker, sum(least(e, t.end_ms) - greatest(s, t.start_ms)) AS total, min((t.start_ms, t.turn_idx)) AS f
      FROM d JOIN speaker_turns t ON t.recording_id = d.recording_id AND least(e, t.end_ms) > greatest(s, t.start_ms) GROUP BY ALL),
    o AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY recording_id, segment_idx ORDER BY total DESC, f) = 1),
    n AS (
      SELECT d.recording_id, d.segment_idx, t.speaker FROM d JOIN speaker_turns t USING (recording_id)
      WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.recording_id = d.recording_id AND o.segment_idx = d.segment_idx)
      QUALIFY row_number() OVER (PARTITION BY d.recording_id, d.segment_idx ORDER BY abs((t.start_ms + t.end_ms) - (s + e)), t.start_ms, t.turn_idx) = 1)
    SELECT s.*, coalesce(o.speaker, n.speaker) AS speaker, CASE WHEN o.speaker IS NOT NULL THEN 'overlap' WHEN n.speaker IS NOT NULL THEN 'nearest' END AS speaker_by
    FROM s LEFT JOIN o USING (recording_id, segment_idx) LEFT JOIN n USING (recording_id, segment_idx)""", using=("utterances", "speaker_turns"))
def segment_speakers_default(spark, sf_dir):
    """Segments whose times are partly unknown: what is missing counts as 0."""
    segments, turns = _inputs(spark, sf_dir)
    partly = segments.select(
        "recording_id", "segment_idx", F.when(F.col("segment_idx") % 5 != 2, F.col("start_ms")).alias("start_ms"),
        F.when(F.col("segment_idx") % 7 != 3, F.col("end_ms")).alias("end_ms"))
    return sp.assign_speakers(partly, turns, fill_nearest=True, whole_segments=True)


@query("cluster_speakers", """
    WITH v AS (
      SELECT vec_id, vec_id % 13 AS recording_id, (vec_id // 13) % (2 + vec_id % 13 % 3) AS who FROM embeddings WHERE embedding IS NOT NULL),
    m AS (SELECT recording_id, who, min(vec_id) AS least FROM v GROUP BY ALL),
    f AS (SELECT recording_id, who, row_number() OVER (PARTITION BY recording_id ORDER BY least) - 1 AS k FROM m)
    SELECT vec_id, recording_id, 'SPEAKER_' || lpad(k::VARCHAR, 2, '0') AS speaker FROM v JOIN f USING (recording_id, who)""")
def cluster_speakers(spark, sf_dir):
    """Vectors of 13 recordings, moved apart by speaker; a recording has two to four, within bounds of its own."""
    at = F.col("vec_id")
    recording = at % 13
    many = 2 + recording % 3
    who = F.floor(at / 13) % many
    moved = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == who, 6.0).otherwise(0.0))
    vectors = corpus.table(spark, sf_dir, "embeddings").filter("embedding is not null").select(
        "vec_id", recording.alias("recording_id"), moved.alias("embedding"),
        F.when(recording % 2 == 0, many).otherwise(2).alias("min_speakers"), F.when(recording % 2 == 0, many).otherwise(6).alias("max_speakers"))
    return sp.cluster_speakers(vectors).select("vec_id", "recording_id", "speaker")
