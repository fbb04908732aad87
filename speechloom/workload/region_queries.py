"""Speech regions and chunks on the event scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechloom.operators import regions as rg
from speechloom.params import Hysteresis
from speechloom.sources import corpus
from speechloom.workload.registry import TABLES, query

LEVELS = Hysteresis(onset=60.0, offset=30.0)
CHUNK_US = 172_800_000_000
COLLAR_US = 20_000_000_000
MIN_US = 40_000_000_000


def _regions(spark, sf_dir):
    return rg.hysteresis(corpus.score_frames(spark, sf_dir), LEVELS)


@query("hysteresis", "SELECT * FROM regions", using=("regions",))
def hysteresis(spark, sf_dir):
    return _regions(spark, sf_dir)


@query("min_duration", f"SELECT * FROM regions WHERE end_us - start_us >= {MIN_US}", using=("regions",))
def min_duration(spark, sf_dir):
    return rg.drop_short(_regions(spark, sf_dir), MIN_US)


@query("fill_gaps", f"""
    WITH padded AS (SELECT recording_id, class, start_us - 3000000000 AS s, end_us + 2000000000 AS e FROM raw_regions),
    reach AS (SELECT *, max(e) OVER (PARTITION BY recording_id, class ORDER BY s, e
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM padded),
    islands AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + {COLLAR_US} THEN 1 ELSE 0 END) OVER (
        PARTITION BY recording_id, class ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM reach),
    merged AS (SELECT recording_id, class, min(s) AS start_us, max(e) AS end_us FROM islands
        GROUP BY recording_id, class, i)
    SELECT recording_id, class, CAST(row_number() OVER (PARTITION BY recording_id, class ORDER BY start_us) - 1
      AS BIGINT) AS region_idx, start_us, end_us FROM merged""", using=("raw_regions",))
def fill_gaps(spark, sf_dir):
    padded = Hysteresis(60.0, 30.0, pad_onset=3_000_000_000, pad_offset=2_000_000_000)
    return rg.fill_gaps(rg.hysteresis(corpus.score_frames(spark, sf_dir), padded), COLLAR_US)


@query("timeline", """
    WITH d AS (SELECT DISTINCT recording_id, start_us, end_us FROM regions)
    SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY start_us, end_us) - 1 AS BIGINT)
      AS region_idx, start_us, end_us, 'UNKNOWN' AS speaker FROM d""", using=("regions",))
def timeline(spark, sf_dir):
    return rg.timeline(_regions(spark, sf_dir))


MIN_CUT_SQL = f"""
    WITH RECURSIVE f AS (
      SELECT recording_id, class, t_us AS t, score AS y,
        row_number() OVER (PARTITION BY recording_id, class ORDER BY t_us, event_id) AS i,
        count(*) OVER (PARTITION BY recording_id, class) AS n FROM score_frames),
    st AS (
      SELECT recording_id, class, i, n, t AS s0, y > 60 AS active, [t] AS kt, [y] AS ky,
        CAST(NULL AS BIGINT) AS out_s, CAST(NULL AS BIGINT) AS out_e, t AS seen_at
      FROM f WHERE i = 1
      UNION ALL
      SELECT recording_id, class, i, n,
        CASE WHEN cut THEN kt[p] WHEN fall OR rise THEN t ELSE s0 END,
        CASE WHEN fall THEN false WHEN rise THEN true ELSE active END,
        CASE WHEN cut THEN list_append(kt[p + 1:], t) WHEN fall THEN [t] WHEN active THEN list_append(kt, t)
          ELSE kt END,
        CASE WHEN cut THEN list_append(ky[p + 1:], y) WHEN fall THEN [y] WHEN active THEN list_append(ky, y)
          ELSE ky END,
        CASE WHEN cut OR fall THEN s0 END,
        CASE WHEN cut THEN kt[p] WHEN fall THEN t END, t
      FROM (
        SELECT st.recording_id, st.class, f.i, f.n, f.t, f.y, st.s0, st.active, st.kt, st.ky,
          st.active AND f.t - st.s0 > {CHUNK_US} AS cut,
          st.active AND NOT (f.t - st.s0 > {CHUNK_US}) AND f.y < 30 AS fall,
          NOT st.active AND f.y > 60 AS rise,
          len(st.ky) // 2 + list_position(st.ky[len(st.ky) // 2 + 1:], list_min(st.ky[len(st.ky) // 2 + 1:])) AS p
        FROM st JOIN f ON f.recording_id = st.recording_id AND f.class = st.class AND f.i = st.i + 1)),
    pieces AS (
      SELECT recording_id, class, out_s AS start_us, out_e AS end_us FROM st WHERE out_s IS NOT NULL
      UNION ALL SELECT recording_id, class, s0, seen_at FROM st WHERE i = n AND active)
    SELECT recording_id, class, CAST(row_number() OVER (PARTITION BY recording_id, class ORDER BY start_us, end_us)
      - 1 AS BIGINT) AS region_idx, start_us, end_us FROM pieces WHERE end_us > start_us"""


@query("min_cut", MIN_CUT_SQL, using=("score_frames",))
def min_cut(spark, sf_dir):
    return rg.min_cut(corpus.score_frames(spark, sf_dir), LEVELS, CHUNK_US)


PACK_SQL = f"""
    WITH RECURSIVE st AS (
      SELECT recording_id, rn, start_us AS cs, end_us AS ce, start_us, end_us, CAST(0 AS BIGINT) AS chunk_idx
      FROM all_regions WHERE rn = 1
      UNION ALL
      SELECT r.recording_id, r.rn,
        CASE WHEN r.end_us - st.cs > {CHUNK_US} AND st.ce - st.cs > 0 THEN r.start_us ELSE st.cs END, r.end_us,
        r.start_us, r.end_us,
        st.chunk_idx + CASE WHEN r.end_us - st.cs > {CHUNK_US} AND st.ce - st.cs > 0 THEN 1 ELSE 0 END
      FROM st JOIN all_regions r ON r.recording_id = st.recording_id AND r.rn = st.rn + 1)
    SELECT recording_id, chunk_idx, min(start_us) AS start_us, arg_max(end_us, rn) AS end_us, count(*) AS n_segments,
      string_agg(start_us || '-' || end_us, ',' ORDER BY rn) AS members
    FROM st GROUP BY recording_id, chunk_idx"""


@query("pack_chunks", PACK_SQL, using=("all_regions",))
def pack_chunks(spark, sf_dir):
    return flat_chunks(rg.pack_chunks(rg.timeline(_regions(spark, sf_dir)), CHUNK_US))


def flat_chunks(chunks):
    members = F.transform("segments", lambda s: F.concat_ws("-", s["start_us"], s["end_us"]))
    return chunks.select(
        "recording_id", "chunk_idx", "start_us", "end_us", F.size("segments").cast("bigint").alias("n_segments"),
        F.array_join(members, ",").alias("members"))


# The whole chain from a detector's frames: thresholds, padding, merging, short regions dropped, packing.
CHAIN = Hysteresis(0.6, 0.3, pad_onset=3_000_000_000, pad_offset=2_000_000_000, min_on_us=MIN_US, min_off_us=COLLAR_US)
TABLES["speech"] = (("raw_regions",), f"""
    WITH padded AS (SELECT recording_id, class, start_us - 3000000000 AS s, end_us + 2000000000 AS e FROM raw_regions),
    reach AS (SELECT *, max(e) OVER (PARTITION BY recording_id, class ORDER BY s, e
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM padded),
    islands AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + {COLLAR_US} THEN 1 ELSE 0 END) OVER (
        PARTITION BY recording_id, class ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM reach),
    merged AS (SELECT recording_id, class, min(s) AS start_us, max(e) AS end_us FROM islands GROUP BY recording_id, class, i),
    d AS (SELECT DISTINCT recording_id, start_us, end_us FROM merged WHERE end_us - start_us >= {MIN_US})
    SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_us, end_us) AS rn FROM d""")


@query("speech_chunks", PACK_SQL.replace("all_regions", "speech"), using=("speech",))
def speech_chunks(spark, sf_dir):
    """A detector run in batches, and chunks from its frame scores."""
    frames = corpus.score_frames(spark, sf_dir).withColumnRenamed("score", "value")
    scores = rg.score_with(frames, _level_detector, "recording_id bigint, class string, t_us bigint, event_id bigint, score double")
    return flat_chunks(rg.chunks_from(scores, CHUNK_US, CHAIN, cut=False))


def _level_detector(batches):
    """A stand-in region detector: a frame score from every batch of values."""
    for batch in batches:
        batch["score"] = batch["value"].clip(lower=0.0) / 100.0
        yield batch[["recording_id", "class", "t_us", "event_id", "score"]]


@query("plugin_scores", """
    SELECT recording_id, class, t_us, event_id, greatest(score, 0.0) / 100.0 AS score FROM score_frames""",
    using=("score_frames",))
def plugin_scores(spark, sf_dir):
    frames = corpus.score_frames(spark, sf_dir).withColumnRenamed("score", "value")
    return rg.score_with(frames, _level_detector,
                         "recording_id bigint, class string, t_us bigint, event_id bigint, score double")
