"""Transcript files of the conversation turns, as ordered lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechloom.operators import writers as wr
from speechloom.sources import corpus, recordings
from speechloom.workload.cue_queries import LIMITS, by_segment_sql, fmt, nested_segments, secs, strip
from speechloom.workload.registry import TABLES, query

TABLES.update({
    "wide_cues": (("null_words", "segment_times"), by_segment_sql(1000)),
    "segment_cue_rows": (("wide_cues",), """
        SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY segment_idx) AS n FROM wide_cues"""),
    "txt": (("utterances",), f"""
        SELECT recording_id, CAST(segment_idx AS VARCHAR) AS ord, '[' || speaker || ']: ' || {strip('text')} AS line
        FROM utterances"""),
    "tsv": (("utterances",), f"""
        SELECT DISTINCT recording_id, '-1' AS ord, 'start' || chr(9) || 'end' || chr(9) || 'text' AS line FROM utterances
        UNION ALL
        SELECT recording_id, CAST(segment_idx AS VARCHAR), start_ms || chr(9) || end_ms || chr(9) ||
          replace({strip('text')}, chr(9), ' ') FROM utterances"""),
    "aud": (("utterances",), f"""
        SELECT recording_id, CAST(segment_idx AS VARCHAR) AS ord, {secs('start_ms')} || chr(9) || {secs('end_ms')} || chr(9)
          || '[[' || speaker || ']]' || replace({strip('text')}, chr(9), ' ') AS line FROM utterances"""),
    "srt": (("segment_cue_rows",), f"""
        SELECT recording_id, CAST(n AS VARCHAR) AS ord, n || chr(10) || {fmt('start_ms', True, ',')} || ' --> ' ||
          {fmt('end_ms', True, ',')} || chr(10) || text || chr(10) AS line FROM segment_cue_rows"""),
    "vtt": (("segment_cue_rows",), f"""
        SELECT DISTINCT recording_id, '-1,-1' AS ord, 'WEBVTT' || chr(10) AS line FROM segment_cue_rows
        UNION ALL
        SELECT recording_id, segment_idx || ',0', {fmt('start_ms', False, '.')} || ' --> ' ||
          {fmt('end_ms', False, '.')} || chr(10) || text || chr(10) FROM segment_cue_rows"""),
    "word_docs": (("null_words",), f"""
        SELECT recording_id, segment_idx, pos, '{{' || concat_ws(', ', '"word": ' || CAST(to_json(word) AS VARCHAR),
          '"start": ' || {secs('start_ms')}, '"end": ' || {secs('end_ms')}) || '}}' AS doc FROM null_words"""),
    "json": (("word_docs", "utterances"), f"""
        WITH seg AS (
          SELECT u.recording_id, u.segment_idx, '{{"start": ' || {secs('u.start_ms')} || ', "end": ' || {secs('u.end_ms')} ||
            ', "text": ' || CAST(to_json(u.text) AS VARCHAR) || ', "words": [' || string_agg(w.doc, ', ' ORDER BY pos) ||
            '], "speaker": ' || CAST(to_json(u.speaker) AS VARCHAR) || '}}' AS doc
          FROM utterances u JOIN word_docs w USING (recording_id, segment_idx)
          GROUP BY u.recording_id, u.segment_idx, u.start_ms, u.end_ms, u.text, u.speaker),
        heads AS (SELECT DISTINCT recording_id FROM utterances)
        SELECT recording_id, '0,0,0' AS ord, '{{"segments": [' AS line FROM heads
        UNION ALL SELECT recording_id, '1,' || segment_idx || ',0', CASE WHEN row_number() OVER (PARTITION BY recording_id
          ORDER BY segment_idx) = 1 THEN '' ELSE ', ' END || doc FROM seg
        UNION ALL SELECT recording_id, '2,0,0', '], "word_segments": [' FROM heads
        UNION ALL SELECT recording_id, '3,' || segment_idx || ',' || pos, CASE WHEN row_number() OVER (
          PARTITION BY recording_id ORDER BY segment_idx, pos) = 1 THEN '' ELSE ', ' END || doc FROM word_docs
        UNION ALL SELECT recording_id, '6,0,0', '], "language": "fr"}}' FROM heads"""),
})


def shown(lines):
    return lines.withColumn("ord", F.array_join(F.col("ord").cast("array<string>"), ","))


for _name, _key in (("txt_lines", "txt"), ("tsv_rows", "tsv"), ("aud_rows", "aud"), ("srt_blocks", "srt"),
                    ("vtt_blocks", "vtt"), ("json_docs", "json")):
    def _lines(spark, sf_dir, key=_key):
        return shown(wr.writers_for(key)[key](nested_segments(spark, sf_dir)))

    query(_name, f'SELECT * FROM "{_key}"', using=(_key,))(_lines)


@query("format_fanout", "\nUNION ALL ".join(
    f"SELECT *, '{k}' AS format FROM \"{k}\"" for k in ("txt", "vtt", "srt", "tsv", "json")),
    using=("txt", "vtt", "srt", "tsv", "json"))
def format_fanout(spark, sf_dir):
    return shown(wr.fan_out(nested_segments(spark, sf_dir), "all"))


def _srt_sql(rows: str) -> str:
    """Oracle of an SRT file from numbered cues."""
    return f"""
    SELECT recording_id, CAST(n AS VARCHAR) AS ord, n || chr(10) || {fmt('start_ms', True, ',')} || ' --> ' ||
      {fmt('end_ms', True, ',')} || chr(10) || text || chr(10) AS line FROM ({rows})"""


@query("srt_limited", _srt_sql("""
    SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY cue_idx) AS n FROM limited_cues"""), using=("limited_cues",))
def srt_limited(spark, sf_dir):
    return shown(wr.fan_out(nested_segments(spark, sf_dir), "srt", LIMITS)).drop("format")


@query("vtt_highlight", f"""
    SELECT DISTINCT recording_id, '-1,-1' AS ord, 'WEBVTT' || chr(10) AS line FROM utterances
    UNION ALL
    SELECT recording_id, segment_idx || ',' || step, {fmt('start_ms', False, '.')} || ' --> ' ||
      {fmt('end_ms', False, '.')} || chr(10) || text || chr(10) FROM highlighted""", using=("highlighted", "utterances"))
def vtt_highlight(spark, sf_dir):
    return shown(wr.fan_out(nested_segments(spark, sf_dir), "vtt", highlight=True)).drop("format")


@query("srt_unaligned", _srt_sql(f"""
    SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY segment_idx) AS n FROM (
      SELECT recording_id, segment_idx, start_ms, end_ms, text FROM wide_cues WHERE recording_id % 3 <> 0
      UNION ALL
      SELECT recording_id, segment_idx, start_ms, end_ms, '[' || speaker || ']: ' || replace({strip('text')}, '-->', '->')
      FROM utterances WHERE recording_id % 3 = 0)"""), using=("wide_cues", "utterances"))
def srt_unaligned(spark, sf_dir):
    """Every third recording was never aligned."""
    words = F.when(F.col("recording_id") % 3 != 0, F.col("words"))
    return shown(wr.fan_out(nested_segments(spark, sf_dir).withColumn("words", words), "srt")).drop("format")


@query("custom_writer", """
    SELECT recording_id, CAST(segment_idx AS VARCHAR) AS ord, speaker || ';' || (end_ms - start_ms) AS line, 'lengths' AS format
    FROM utterances""",
    using=("utterances",))
def custom_writer(spark, sf_dir):
    def lengths(nested):
        return nested.select(
            "recording_id", F.array("segment_idx").alias("ord"),
            F.concat_ws(";", "speaker", (F.col("end_ms") - F.col("start_ms")).cast("string")).alias("line"))

    wr.register_writer("lengths", lengths)
    return shown(wr.fan_out(nested_segments(spark, sf_dir), "lengths"))


@query("recording_ids", """
    SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '([^.])\\.[^.]*$', '\\1') AS recording_id FROM pages""")
def recording_ids(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages").select(
        "page_id", recordings.recording_id(F.col("url")).alias("recording_id"))
