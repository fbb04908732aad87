"""Cues, subtitle files and split subtitles of the conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechloom.functions import text as tx, time as tm
from speechloom.functions.fixed_values import CONJUNCTIONS
from speechloom.operators import cues as cu, subtitles as sb, writers as wr
from speechloom.params import CueLimits
from speechloom.sources import corpus
from speechloom.workload.registry import TABLES, query

LIMITS = CueLimits(max_line_width=42, max_line_count=2)


def fmt(ms: str, hours: bool, marker: str) -> str:
    """Oracle text of a timestamp."""
    h = f"lpad(CAST({ms} // 3600000 AS VARCHAR), 2, '0') || ':'"
    rest = (f"lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS VARCHAR), 2, "
            f"'0') || '{marker}' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')")
    return f"{h} || {rest}" if hours else f"(CASE WHEN {ms} >= 3600000 THEN {h} ELSE '' END) || {rest}"


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
strip = STRIP.format


def secs(ms: str) -> str:
    return (f"({ms} // 1000) || '.' || CASE WHEN {ms} % 1000 = 0 THEN '0' "
            f"ELSE rtrim(lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0'), '0') END")


TABLES.update({
    "segment_times": (("null_words", "utterances"), """
        SELECT u.recording_id, u.segment_idx, u.speaker, u.text, u.start_ms AS s0, u.end_ms AS e0,
          min(w.start_ms) AS ws, max(w.end_ms) AS we
        FROM null_words w JOIN utterances u USING (recording_id, segment_idx) GROUP BY ALL"""),
    "laid_words": (("null_words",), r"""
        WITH RECURSIVE n AS (
          SELECT recording_id, segment_idx, pos, word, start_ms, end_ms, length(word) AS len,
            length(regexp_replace(word, '^\s+|\s+$', '', 'g')) AS bare,
            row_number() OVER (PARTITION BY recording_id ORDER BY segment_idx, pos) AS i FROM null_words),
        st AS (
          SELECT recording_id, i, bare AS used, CAST(1 AS BIGINT) AS lines, start_ms AS seen, 2 AS line_mark, 1 AS cue_mark
          FROM n WHERE i = 1
          UNION ALL
          SELECT recording_id, i, CASE WHEN fits THEN used + len ELSE bare END,
            CASE WHEN fits THEN lines WHEN brk THEN 1 WHEN used > 0 THEN lines + 1 ELSE lines END,
            coalesce(start_ms, seen),
            CASE WHEN fits THEN 0 WHEN brk OR used = 0 THEN 2 ELSE 1 END,
            CASE WHEN NOT fits AND brk THEN 1 ELSE 0 END
          FROM (SELECT n.*, st.used, st.lines, st.seen,
              st.used > 0 AND st.used + n.len <= 42 AND NOT coalesce(n.start_ms - st.seen > 3000, false) AS fits,
              coalesce(n.start_ms - st.seen > 3000, false) OR st.lines >= 2 AS brk
            FROM st JOIN n ON n.recording_id = st.recording_id AND n.i = st.i + 1))
        SELECT n.*, st.line_mark,
          sum(st.cue_mark) OVER (PARTITION BY n.recording_id ORDER BY n.i ROWS UNBOUNDED PRECEDING) AS cue
        FROM st JOIN n USING (recording_id, i)"""),
    "limited_cues": (("laid_words", "utterances"), r"""
        SELECT w.recording_id, CAST(cue - 1 AS BIGINT) AS cue_idx,
          CASE WHEN min(w.start_ms) IS NOT NULL AND max(w.end_ms) IS NOT NULL THEN min(w.start_ms)
            ELSE arg_min(u.start_ms, i) END AS start_ms,
          CASE WHEN min(w.start_ms) IS NOT NULL AND max(w.end_ms) IS NOT NULL THEN max(w.end_ms)
            ELSE arg_min(u.end_ms, i) END AS end_ms,
          '[' || arg_min(u.speaker, i) || ']: ' || string_agg(CASE line_mark WHEN 0 THEN word
            WHEN 1 THEN chr(10) || regexp_replace(word, '^\s+|\s+$', '', 'g')
            ELSE regexp_replace(word, '^\s+|\s+$', '', 'g') END, ' ' ORDER BY i) AS text
        FROM laid_words w JOIN utterances u USING (recording_id, segment_idx) GROUP BY w.recording_id, cue"""),
    "next_starts": (("utterances",), """
        SELECT recording_id, segment_idx, text, start_ms, end_ms,
          lead(start_ms) OVER (PARTITION BY recording_id ORDER BY segment_idx) AS next_start_ms FROM utterances"""),
    "estimated": (("null_words", "next_starts"), """
        WITH RECURSIVE w AS (
          SELECT n.*, s.next_start_ms AS nss, length(word) * 250 AS size,
            n.start_ms IS NULL OR n.end_ms IS NULL AS gap,
            lead(n.start_ms) OVER (PARTITION BY recording_id, segment_idx ORDER BY pos) AS follow
          FROM null_words n JOIN next_starts s USING (recording_id, segment_idx)),
        st AS (
          SELECT recording_id, segment_idx, pos, word,
            CAST(CASE WHEN NOT gap THEN start_ms WHEN follow IS NOT NULL THEN follow - size
              ELSE coalesce(nss - 1000, 0) END AS BIGINT) AS start_ms,
            CAST(CASE WHEN NOT gap THEN end_ms ELSE coalesce(follow, nss - 500, 0) END AS BIGINT) AS end_ms
          FROM w WHERE pos = 0
          UNION ALL
          SELECT w.recording_id, w.segment_idx, w.pos, w.word,
            CAST(CASE WHEN NOT gap THEN w.start_ms ELSE st.end_ms END AS BIGINT),
            CAST(CASE WHEN NOT gap THEN w.end_ms WHEN follow IS NOT NULL THEN follow
              WHEN nss IS NOT NULL THEN CASE WHEN nss - st.end_ms <= 1000 THEN nss ELSE nss - 500 END
              ELSE st.end_ms + size END AS BIGINT)
          FROM st JOIN w ON w.recording_id = st.recording_id AND w.segment_idx = st.segment_idx AND w.pos = st.pos + 1)
        SELECT * FROM st"""),
})


def conjunction_sql(word: str, lang: str) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in CONJUNCTIONS[lang])
    return f"lower({word}) IN ({listed})"


def split_tables(prefix: str, words: str, size: int, counted: int, comma: str, lang: str) -> dict:
    """Oracle of the split points: a walk over the words of every segment."""
    return {
        f"{prefix}_walk": ((words,), f"""
        WITH RECURSIVE a AS (
          SELECT recording_id, segment_idx, pos, word, length(word) AS len,
            sum(length(word) + {counted}) OVER (PARTITION BY recording_id, segment_idx ORDER BY pos
              ROWS UNBOUNDED PRECEDING) AS reach,
            sum(length(word) + {counted}) OVER (PARTITION BY recording_id, segment_idx) AS total,
            list(length(word) + {counted}) OVER (PARTITION BY recording_id, segment_idx ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lens,
            ends_with(word, '{comma}') AS comma_end, {conjunction_sql('word', lang)} AS conj FROM {words}),
        st AS (
          SELECT recording_id, segment_idx, -1 AS pos, CAST(0 AS HUGEINT) AS base, CAST(0 AS HUGEINT) AS line,
            total AS rest, CAST(NULL AS HUGEINT) AS cut FROM a WHERE pos = 0
          UNION ALL
          SELECT recording_id, segment_idx, pos,
            CASE how WHEN 1 THEN (base + pos + 1) // 2 + 1 WHEN 2 THEN pos + 1 WHEN 3 THEN pos ELSE base END,
            CASE how WHEN 1 THEN coalesce(list_sum(lens[CAST((base + pos + 1) // 2 + 2 AS BIGINT):]), 0) WHEN 2 THEN 0
              WHEN 3 THEN step ELSE line + step END,
            rest - step,
            CASE how WHEN 1 THEN (base + pos + 1) // 2 WHEN 2 THEN pos WHEN 3 THEN pos - 1 END
          FROM (SELECT a.recording_id, a.segment_idx, a.pos, a.lens, st.base, st.line, st.rest, a.len + {size} AS step,
              CASE WHEN st.line + a.len + {size} >= 45 THEN CASE WHEN st.line >= 30 THEN 1 ELSE 0 END
                WHEN comma_end AND st.line >= 30 AND st.rest - a.len - {size} >= 30 THEN 2
                WHEN conj AND st.line >= 30 AND st.rest - a.len - {size} >= 30 THEN 3 ELSE 0 END AS how
            FROM st JOIN a ON a.recording_id = st.recording_id AND a.segment_idx = st.segment_idx AND a.pos = st.pos + 1))
        SELECT recording_id, segment_idx, CAST(cut AS BIGINT) AS cut FROM st WHERE cut IS NOT NULL"""),
        f"{prefix}_parts": ((f"{prefix}_walk", words), f"""
        SELECT w.*, CAST((SELECT count(*) FROM {prefix}_walk c WHERE c.recording_id = w.recording_id
            AND c.segment_idx = w.segment_idx AND c.cut < w.pos) AS INTEGER) AS frag FROM {words} w"""),
    }


TABLES.update(split_tables("est", "estimated", 1, 0, ",", "fr"))
TABLES["plain_words"] = (("utterances",), r"""
    SELECT recording_id, segment_idx, unnest(ws) AS word, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS pos FROM (
      SELECT recording_id, segment_idx, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws
      FROM utterances)""")
TABLES.update(split_tables("plain", "plain_words", 1, 1, ",", "fr"))
TABLES["fragments"] = (("est_parts", "next_starts"), """
    WITH g AS (
      SELECT recording_id, segment_idx, frag, arg_min(start_ms, pos) AS start_ms, arg_max(end_ms, pos) AS e,
        string_agg(word, ' ' ORDER BY pos) AS text FROM est_parts GROUP BY ALL),
    f AS (
      SELECT g.*, coalesce(lead(g.start_ms) OVER (PARTITION BY recording_id, segment_idx ORDER BY frag),
        s.next_start_ms) AS follow FROM g JOIN next_starts s USING (recording_id, segment_idx))
    SELECT recording_id, segment_idx, frag, start_ms, CASE WHEN follow - e <= 800 THEN follow ELSE e END AS end_ms, text
    FROM f""")


def nested_segments(spark, sf_dir, lang="fr"):
    """Turns with their words; some words have no times."""
    segments = corpus.utterances(spark, sf_dir).withColumn("lang", F.lit(lang))
    words = tx.words_with_offsets(F.col("text"))

    def timed(w):
        start = F.col("start_ms") + w["offset"] * corpus.MS_PER_CHAR
        end = start + F.length(w["word"]) * corpus.MS_PER_CHAR
        return F.struct(
            w["word"].alias("word"), F.when(w["word"].rlike("^[a-zA-Z]+$"), start).cast("bigint").alias("start_ms"),
            F.when(w["word"].rlike("^[a-z][a-zA-Z]*$"), end).cast("bigint").alias("end_ms"))

    return segments.withColumn("words", F.transform(words, timed))


@query("fmt_ts", f"SELECT recording_id, segment_idx, {fmt('start_ms', False, '.')} AS t0, "
       f"{fmt('end_ms * 97', False, ',')} AS t1 FROM utterances", using=("utterances",))
def fmt_ts(spark, sf_dir):
    return corpus.utterances(spark, sf_dir).select(
        "recording_id", "segment_idx", tm.format_ms(F.col("start_ms")).alias("t0"),
        tm.format_ms(F.col("end_ms") * 97, marker=",").alias("t1"))


@query("fmt_ts_hours", f"SELECT event_id, {fmt('CAST(round_even(abs(value) * 1000.0, 0) AS BIGINT)', True, ',')} AS t0 "
       "FROM events")
def fmt_ts_hours(spark, sf_dir):
    return corpus.table(spark, sf_dir, "events").select(
        "event_id", tm.format_seconds(F.abs("value"), True, ",").alias("t0"))


@query("clean_text", rf"""
    SELECT doc_id, replace({strip('text')}, '-->', '->') AS cue, replace({strip('text')}, chr(9), ' ') AS line
    FROM documents""")
def clean_text(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id", tx.cue_text(F.col("text")).alias("cue"), tx.one_line(F.col("text")).alias("line"))


@query("speaker_prefix", """
    SELECT conv_id, turn, '[' || role || ']: ' AS prefix, '[[' || role || ']]' AS label FROM conversations""")
def speaker_prefix(spark, sf_dir):
    return corpus.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.speaker_prefix(F.col("role")).alias("prefix"), tx.label_prefix(F.col("role")).alias("label"))


@query("long_pause", """
    SELECT *, coalesce(start_ms - prev_start_ms > 3000, false) AS long_pause FROM (
      SELECT recording_id, segment_idx, pos, word, start_ms, last_value(start_ms IGNORE NULLS) OVER (
        PARTITION BY recording_id ORDER BY segment_idx, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        AS prev_start_ms FROM null_words)""", using=("null_words",))
def long_pause(spark, sf_dir):
    return cu.long_pauses(corpus.null_words(corpus.words(corpus.utterances(spark, sf_dir))))


@query("cue_times", """
    SELECT recording_id, segment_idx, CASE WHEN ws IS NOT NULL AND we IS NOT NULL THEN ws ELSE s0 END AS start_ms,
      CASE WHEN ws IS NOT NULL AND we IS NOT NULL THEN we ELSE e0 END AS end_ms FROM segment_times""",
    using=("segment_times",))
def cue_times(spark, sf_dir):
    start, end = cu.cue_times(F.col("words"), F.col("start_ms"), F.col("end_ms"))
    return nested_segments(spark, sf_dir).select("recording_id", "segment_idx", start.alias("start_ms"), end.alias("end_ms"))


def laid_sql(width: int) -> str:
    """Words of segments as they are shown in lines of a width."""
    return rf"""
      SELECT recording_id, segment_idx, pos, word, length(word) AS len, length({strip('word')}) AS used,
        {strip('word')} AS shown FROM null_words WHERE pos = 0
      UNION ALL
      SELECT w.recording_id, w.segment_idx, w.pos, w.word, length(w.word),
        CASE WHEN l.used > 0 AND l.used + length(w.word) <= {width} THEN l.used + length(w.word)
          ELSE length({strip('w.word')}) END,
        CASE WHEN l.used > 0 AND l.used + length(w.word) <= {width} THEN w.word
          WHEN l.used > 0 THEN chr(10) || {strip('w.word')} ELSE {strip('w.word')} END
      FROM l JOIN null_words w ON w.recording_id = l.recording_id AND w.segment_idx = l.segment_idx AND w.pos = l.pos + 1"""


def by_segment_sql(width: int) -> str:
    """Oracle of cues that follow their segments."""
    return rf"""
    WITH RECURSIVE l AS ({laid_sql(width)})
    SELECT recording_id, segment_idx, CASE WHEN ws IS NOT NULL AND we IS NOT NULL THEN ws ELSE s0 END AS start_ms,
      CASE WHEN ws IS NOT NULL AND we IS NOT NULL THEN we ELSE e0 END AS end_ms,
      '[' || speaker || ']: ' || string_agg(shown, ' ' ORDER BY pos) AS text
    FROM l JOIN segment_times USING (recording_id, segment_idx)
    GROUP BY recording_id, segment_idx, speaker, s0, e0, ws, we"""


@query("cues_by_segment", by_segment_sql(80), using=("null_words", "segment_times"))
def cues_by_segment(spark, sf_dir):
    return cu.cues_by_segment(nested_segments(spark, sf_dir), CueLimits(max_line_width=80)).drop("words", "speaker", "lang")


@query("cues_limited", "SELECT * FROM limited_cues", using=("limited_cues",))
def cues_limited(spark, sf_dir):
    return cu.cues_limited(nested_segments(spark, sf_dir), LIMITS).drop("words", "speaker", "lang")


TABLES["shown_words"] = (("null_words",), f"WITH RECURSIVE l AS ({laid_sql(1000)}) SELECT recording_id, segment_idx, pos, shown FROM l")
TABLES["highlighted"] = (("null_words", "segment_times", "shown_words"), r"""
    WITH c AS (
      SELECT w.recording_id, w.segment_idx, w.pos, w.start_ms AS s, coalesce(w.end_ms, w.start_ms) AS e,
        CASE WHEN t.ws IS NOT NULL AND t.we IS NOT NULL THEN t.ws ELSE t.s0 END AS cs,
        CASE WHEN t.ws IS NOT NULL AND t.we IS NOT NULL THEN t.we ELSE t.e0 END AS ce,
        '[' || t.speaker || ']: ' AS prefix, t.ws IS NOT NULL AS timed,
        list(shown) OVER (PARTITION BY w.recording_id, w.segment_idx ORDER BY w.pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ws
      FROM null_words w JOIN shown_words USING (recording_id, segment_idx, pos) JOIN segment_times t USING (recording_id, segment_idx)),
    k AS (
      SELECT *, coalesce(lag(e) OVER (PARTITION BY recording_id, segment_idx ORDER BY pos), cs) AS last,
        row_number() OVER (PARTITION BY recording_id, segment_idx ORDER BY pos) - 1 AS k FROM c WHERE s IS NOT NULL)
    SELECT recording_id, segment_idx, CAST(2 * k AS INTEGER) AS step, last AS start_ms, s AS end_ms,
      prefix || array_to_string(ws, ' ') AS text FROM k WHERE last <> s
    UNION ALL
    SELECT recording_id, segment_idx, CAST(2 * k + 1 AS INTEGER), s, e, prefix || array_to_string(list_concat(list_concat(
      ws[1:pos], [regexp_replace(ws[pos + 1], '^(\s*)(.*)$', '\1<u>\2</u>')]), ws[pos + 2:]), ' ') FROM k
    UNION ALL
    SELECT recording_id, segment_idx, 0, cs, ce, prefix || array_to_string(ws, ' ') FROM c WHERE NOT timed AND pos = 0""")


@query("highlight_cues", "SELECT * FROM highlighted", using=("highlighted",))
def highlight_cues(spark, sf_dir):
    return cu.highlight_cues(cu.cues_by_segment(nested_segments(spark, sf_dir)))


@query("segment_cues", f"""
    SELECT recording_id, segment_idx, start_ms, end_ms, '[' || speaker || ']: ' || replace({strip('text')}, '-->', '->')
      AS text FROM utterances""", using=("utterances",))
def segment_cues(spark, sf_dir):
    return cu.segment_cues(corpus.utterances(spark, sf_dir))


@query("script_limits", """
    SELECT doc_id, CASE WHEN code IN ('ja', 'ko') THEN 30 ELSE 45 END AS max_line,
      CASE WHEN code IN ('ja', 'ko') THEN 20 ELSE 30 END AS min_chars
    FROM (SELECT doc_id, CASE lang WHEN 'de' THEN 'ja' WHEN 'es' THEN 'ko' ELSE lang END AS code FROM documents)""")
def script_limits(spark, sf_dir):
    code = F.when(F.col("lang") == "de", "ja").when(F.col("lang") == "es", "ko").otherwise(F.col("lang"))
    longest, shortest = sb.script_limits(code)
    return corpus.table(spark, sf_dir, "documents").select("doc_id", longest.alias("max_line"), shortest.alias("min_chars"))


def _estimated(spark, sf_dir):
    segments = corpus.utterances(spark, sf_dir)
    following = cu.next_segment_start(segments.select("recording_id", "segment_idx", "text", "start_ms", "end_ms"))
    words = following.select(
        "recording_id", "segment_idx", "next_start_ms", F.col("start_ms").alias("_t0"),
        F.posexplode(tx.words_with_offsets(F.col("text"))).alias("pos", "_w"))
    start = F.col("_t0") + F.col("_w.offset") * corpus.MS_PER_CHAR
    flat = words.select("recording_id", "segment_idx", "pos", F.col("_w.word").alias("word"), start.alias("start_ms"),
                        (start + F.length("_w.word") * corpus.MS_PER_CHAR).alias("end_ms"), "next_start_ms")
    return sb.estimate_word_times(corpus.null_words(flat))


@query("estimate_word_times", "SELECT * FROM estimated", using=("estimated",))
def estimate_word_times(spark, sf_dir):
    return _estimated(spark, sf_dir).drop("next_start_ms")


def _estimated_segments(spark, sf_dir):
    """Segments rebuilt from their estimated words; the grouping reuses the shuffle of the estimation."""
    words = _estimated(spark, sf_dir)
    nested = words.groupBy("recording_id", "segment_idx").agg(
        F.sort_array(F.collect_list(F.struct("pos", "word", "start_ms", "end_ms"))).alias("words"),
        F.max("next_start_ms").alias("next_start_ms"), F.max("end_ms").alias("end_ms"))
    return nested.withColumn("lang", F.lit("fr"))


@query("split_points", """
    SELECT recording_id, segment_idx, cut FROM est_walk""", using=("est_walk",))
def split_points(spark, sf_dir):
    split = sb.with_split_points(_estimated_segments(spark, sf_dir), True)
    return split.select("recording_id", "segment_idx", F.explode(F.col("splits").cast("array<bigint>")).alias("cut"))


def _fragments(spark, sf_dir):
    return sb.split_timed(_estimated_segments(spark, sf_dir))


@query("split_fragments", "SELECT * FROM fragments", using=("fragments",))
def split_fragments(spark, sf_dir):
    return _fragments(spark, sf_dir)


@query("split_srt", f"""
    SELECT recording_id, n AS number, n || chr(10) || {fmt('s', True, ',')} || ' --> ' || {fmt('e', True, ',')}
      || chr(10) || {strip('text')} || chr(10) AS line
    FROM (SELECT *, greatest(start_ms, 0) AS s, greatest(end_ms, 0) AS e, row_number() OVER (PARTITION BY recording_id ORDER BY segment_idx, frag) AS n FROM fragments)""",
    using=("fragments",))
def split_srt(spark, sf_dir):
    return wr.split_lines(_fragments(spark, sf_dir)).select(
        "recording_id", F.get("ord", 0).alias("number"), "line")


@query("split_vtt", f"""
    SELECT DISTINCT recording_id, -1 AS number, 'WEBVTT' || chr(10) AS line FROM fragments
    UNION ALL
    SELECT recording_id, n, n || chr(10) || {fmt('s', True, '.')} || ' --> ' || {fmt('e', True, '.')}
      || chr(10) || {strip('text')} || chr(10)
    FROM (SELECT *, greatest(start_ms, 0) AS s, greatest(end_ms, 0) AS e, row_number() OVER (PARTITION BY recording_id ORDER BY segment_idx, frag) AS n FROM fragments)""",
    using=("fragments",))
def split_vtt(spark, sf_dir):
    return wr.split_lines(_fragments(spark, sf_dir), is_vtt=True).select(
        "recording_id", F.get("ord", 0).alias("number"), "line")


@query("proportional_times", """
    WITH g AS (
      SELECT recording_id, segment_idx, frag, min(pos) AS a, max(pos) AS b, string_agg(word, ' ' ORDER BY pos) AS text
      FROM plain_parts GROUP BY ALL),
    f AS (
      SELECT g.*, s.start_ms AS s0, s.end_ms - s.start_ms AS d, s.next_start_ms AS nss,
        max(b) OVER (PARTITION BY recording_id, segment_idx) + 1 AS n
      FROM g JOIN next_starts s USING (recording_id, segment_idx)),
    t AS (
      SELECT *, s0 + CAST(round_even(d * a / n, 0) AS BIGINT) AS start_ms,
        s0 + CAST(round_even(d * (b + 1) / n, 0) AS BIGINT) AS e FROM f)
    SELECT recording_id, segment_idx, frag, start_ms,
      CASE WHEN b + 1 = n AND nss - e <= 800 THEN nss ELSE e END AS end_ms, text FROM t""",
    using=("plain_parts", "next_starts"))
def proportional_times(spark, sf_dir):
    segments = corpus.utterances(spark, sf_dir).withColumn("lang", F.lit("fr"))
    return sb.split_plain(cu.next_segment_start(segments))


@query("plain_subtitles", "SELECT recording_id, segment_idx, start_ms, end_ms, text FROM utterances", using=("utterances",))
def plain_subtitles(spark, sf_dir):
    return sb.plain_subtitles(corpus.utterances(spark, sf_dir))
