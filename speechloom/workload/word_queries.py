"""Characters, words and sentences of the conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechloom.functions.text import characters
from speechloom.operators import words as wd
from speechloom.sources import corpus
from speechloom.workload.registry import TABLES, query

TABLES.update({
    "char_lists": (("utterances",), "SELECT *, string_split(text, '') AS cs FROM utterances"),
    "chars": (("char_lists",), """
        SELECT recording_id, segment_idx, start_ms AS t0, unnest(cs) AS char,
          CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS cdx FROM char_lists"""),
    "char_times": (("chars",), """
        SELECT *, CASE WHEN regexp_full_match(lower(char), '[a-z ]') THEN t0 + 60 * cdx END AS s,
          CASE WHEN regexp_full_match(lower(char), '[a-z ]') THEN t0 + 60 * cdx + 60 END AS e,
          CASE WHEN regexp_full_match(lower(char), '[a-z ]') THEN (unicode(char) * 37 + cdx * 11) % 1000 END AS milli
        FROM chars"""),
    "pieces": (("utterances",), r"""
        WITH b AS (
          SELECT recording_id, segment_idx, length(text) - length(regexp_replace(text, '^\s+', '')) AS lead,
            regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'),
              '\b(Mr|Mrs|Ms|Dr|Prof|St|vs|etc|No|Nr|Sr|Sra|Mme|bzw)\.(\s)', '\1' || chr(57346) || '\2', 'g'),
              '([.!?]+)(\s+)', '\1' || chr(57345) || '\2' || chr(57344), 'g') AS body FROM utterances),
        p AS (SELECT *, string_split(body, chr(57344)) AS ps FROM b WHERE body <> '')
        SELECT recording_id, segment_idx, lead, unnest(ps) AS piece,
          CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS sentence_idx FROM p"""),
    "spans": (("pieces",), """
        WITH o AS (
          SELECT *, lead + coalesce(sum(length(replace(piece, chr(57345), ''))) OVER (PARTITION BY recording_id,
            segment_idx ORDER BY sentence_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM pieces)
        SELECT recording_id, segment_idx, sentence_idx, CAST(st AS INTEGER) AS s_start,
          CAST(st + length(split_part(piece, chr(57345), 1)) AS INTEGER) AS s_end,
          replace(split_part(piece, chr(57345), 1), chr(57346), '.') AS sentence FROM o"""),
    "sentence_chars": (("char_times", "spans"), """
        SELECT c.*, s.sentence_idx, s.sentence FROM char_times c JOIN spans s
          ON c.recording_id = s.recording_id AND c.segment_idx = s.segment_idx AND c.cdx BETWEEN s.s_start AND s.s_end"""),
    "char_words": (("sentence_chars",), """
        SELECT *, sum(CASE WHEN char = ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, segment_idx,
            sentence_idx ORDER BY cdx ROWS UNBOUNDED PRECEDING) AS k FROM sentence_chars"""),
    "rolled_words": (("char_words",), r"""
        WITH g AS (
          SELECT recording_id, segment_idx, sentence_idx, CAST(k AS INTEGER) AS word_idx,
            regexp_replace(string_agg(char, '' ORDER BY cdx), '^\s+|\s+$', '', 'g') AS word,
            min(s) FILTER (char <> ' ') AS start_ms, max(e) FILTER (char <> ' ') AS end_ms,
            round_even(avg(milli) FILTER (char <> ' '), 0) / 1000 AS score
          FROM char_words GROUP BY ALL)
        SELECT * FROM g WHERE word <> ''"""),
    "rolled_sentences": (("sentence_chars",), """
        SELECT recording_id, segment_idx, sentence_idx, any_value(sentence) AS text, min(s) AS start_ms,
          max(e) FILTER (char <> ' ') AS end_ms FROM sentence_chars GROUP BY ALL"""),
    "filled_sentences": (("rolled_sentences",), ""),
})


def interpolation_sql(source: str, keys: str, pos: str, keep: str, method: str) -> str:
    """Oracle of the filling of start_ms and end_ms."""

    def fill(v: str) -> str:
        if method == "ignore":
            return v
        inner = (f"CASE WHEN {pos} - {v}_lp <= {v}_rp - {pos} THEN {v}_l ELSE {v}_r END" if method == "nearest" else
                 f"CAST(round_even({v}_l + ({v}_r - {v}_l) * ({pos} - {v}_lp) / ({v}_rp - {v}_lp), 0) AS BIGINT)")
        return (f"CASE WHEN {v} IS NOT NULL THEN {v} WHEN {v}_l IS NOT NULL AND {v}_r IS NOT NULL THEN {inner} "
                f"ELSE coalesce({v}_l, {v}_r) END")

    def sides(v: str) -> str:
        return f"""
          last_value({v} IGNORE NULLS) OVER b AS {v}_l, first_value({v} IGNORE NULLS) OVER a AS {v}_r,
          last_value(CASE WHEN {v} IS NOT NULL THEN {pos} END IGNORE NULLS) OVER b AS {v}_lp,
          first_value(CASE WHEN {v} IS NOT NULL THEN {pos} END IGNORE NULLS) OVER a AS {v}_rp"""

    return f"""
        SELECT {keep}, {fill('start_ms')} AS start_ms, {fill('end_ms')} AS end_ms, n_known, n_all FROM (
          SELECT *, {sides('start_ms')}, {sides('end_ms')},
            count(start_ms) OVER (PARTITION BY {keys}) AS n_known, count(*) OVER (PARTITION BY {keys}) AS n_all
          FROM {source}
          WINDOW b AS (PARTITION BY {keys} ORDER BY {pos} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            a AS (PARTITION BY {keys} ORDER BY {pos} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


SEG = "recording_id, segment_idx"
TABLES["filled_sentences"] = (("rolled_sentences",), interpolation_sql(
    "rolled_sentences", SEG, "sentence_idx", f"{SEG}, sentence_idx, text", "nearest"))


def timed_segments(spark, sf_dir):
    """Turns with a time for every letter and blank."""
    nothing = F.lit(None).cast(wd.TIME)
    times = F.transform(characters(F.col("text")), lambda c, i: F.when(F.lower(c).rlike("^[a-z ]$"), F.struct(
        (F.col("start_ms") + 60 * i).cast("bigint").alias("start_ms"),
        (F.col("start_ms") + 60 * i + 60).cast("bigint").alias("end_ms"),
        ((F.ascii(c) * 37 + i * 11) % 1000 / 1000).alias("score"))).otherwise(nothing))
    return corpus.utterances(spark, sf_dir).select("recording_id", "segment_idx", "text", times.alias("times"))


def segments_en(spark, sf_dir):
    return corpus.utterances(spark, sf_dir).withColumn("lang", F.lit("en"))


@query("tokenize", r"""
    SELECT w.recording_id, w.segment_idx, w.pos, w.word,
      length(u.text) - length(regexp_replace(u.text, '^\s+', '')) AS n_leading,
      length(u.text) - length(regexp_replace(u.text, '\s+$', '')) AS n_trailing
    FROM words w JOIN utterances u USING (recording_id, segment_idx)""", using=("words",))
def tokenize(spark, sf_dir):
    return wd.tokenize(segments_en(spark, sf_dir))


@query("word_index", """
    SELECT recording_id, segment_idx, cdx, char,
      CAST(sum(CASE WHEN char = ' ' AND cdx > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, segment_idx
        ORDER BY cdx ROWS UNBOUNDED PRECEDING) AS INTEGER) AS word_idx FROM chars""", using=("chars",))
def word_index(spark, sf_dir):
    return wd.word_index(segments_en(spark, sf_dir))


@query("sentence_spans", "SELECT * FROM spans", using=("spans",))
def sentence_spans(spark, sf_dir):
    return wd.spans(corpus.utterances(spark, sf_dir))


@query("char_sentence", "SELECT recording_id, segment_idx, cdx, char, sentence_idx FROM sentence_chars",
       using=("sentence_chars",))
def char_sentence(spark, sf_dir):
    return wd.sentence_chars(corpus.utterances(spark, sf_dir))


@query("word_rollup", "SELECT * FROM rolled_words", using=("rolled_words",))
def word_rollup(spark, sf_dir):
    return wd.word_rollup(wd.timed_sentences(timed_segments(spark, sf_dir)))


# Every third recording is taken for Japanese, every third for Chinese: a character is a word, a span ends before its end.
LANG = "CASE recording_id % 3 WHEN 0 THEN 'ja' WHEN 1 THEN 'zh' ELSE 'en' END"
TABLES.update({
    "mixed_chars": (("sentence_chars", "spans"), f"""
        SELECT c.*, {LANG} AS lang FROM sentence_chars c JOIN spans s USING (recording_id, segment_idx, sentence_idx)
        WHERE c.recording_id % 3 = 2 OR c.cdx < s.s_end"""),
    "mixed_words": (("mixed_chars",), """
        SELECT *, CASE WHEN lang = 'en' THEN sum(CASE WHEN char = ' ' THEN 1 ELSE 0 END) OVER s
            ELSE row_number() OVER s - 1 END AS k
        FROM mixed_chars WINDOW s AS (PARTITION BY recording_id, segment_idx, sentence_idx ORDER BY cdx ROWS UNBOUNDED PRECEDING)"""),
})


def mixed_segments(spark, sf_dir):
    """Timed turns whose language, with or without blanks between words, comes from the row."""
    lang = F.when(F.col("recording_id") % 3 == 0, "ja").when(F.col("recording_id") % 3 == 1, "zh").otherwise("en")
    return timed_segments(spark, sf_dir).withColumn("lang", lang)


@query("word_rollup_langs", r"""
    SELECT * FROM (
      SELECT recording_id, segment_idx, sentence_idx, CAST(k AS INTEGER) AS word_idx,
        regexp_replace(string_agg(char, '' ORDER BY cdx), '^\s+|\s+$', '', 'g') AS word,
        min(s) FILTER (char <> ' ' OR lang <> 'en') AS start_ms, max(e) FILTER (char <> ' ' OR lang <> 'en') AS end_ms,
        round_even(avg(milli) FILTER (char <> ' ' OR lang <> 'en'), 0) / 1000 AS score
      FROM mixed_words GROUP BY ALL) WHERE word <> ''""", using=("mixed_words",))
def word_rollup_langs(spark, sf_dir):
    return wd.word_rollup(wd.timed_sentences(mixed_segments(spark, sf_dir)))


@query("sentence_rollup_langs", """
    SELECT recording_id, segment_idx, sentence_idx, any_value(sentence) AS text, min(s) AS start_ms,
      max(e) FILTER (char <> ' ') AS end_ms FROM mixed_chars GROUP BY ALL""", using=("mixed_chars",))
def sentence_rollup_langs(spark, sf_dir):
    return wd.sentence_rollup(wd.timed_sentences(mixed_segments(spark, sf_dir))).select(
        *wd.SEGMENT, "sentence_idx", "text", "start_ms", "end_ms")


def _sentences(spark, sf_dir):
    return wd.sentence_rollup(wd.timed_sentences(timed_segments(spark, sf_dir))).select(
        *wd.SEGMENT, "sentence_idx", "text", "start_ms", "end_ms")


@query("sentence_rollup", "SELECT * FROM rolled_sentences", using=("rolled_sentences",))
def sentence_rollup(spark, sf_dir):
    return _sentences(spark, sf_dir)


@query("sentence_interp", "SELECT recording_id, segment_idx, sentence_idx, text, start_ms, end_ms FROM filled_sentences",
       using=("filled_sentences",))
def sentence_interp(spark, sf_dir):
    return wd.interpolate_sentences(_sentences(spark, sf_dir))


@query("merge_equal_sentences", """
    SELECT recording_id, segment_idx, start_ms, end_ms, min(sentence_idx) AS first_idx,
      string_agg(text, ' ' ORDER BY sentence_idx) AS text, string_agg(sentence_idx, ',' ORDER BY sentence_idx) AS members
    FROM filled_sentences WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL
    GROUP BY recording_id, segment_idx, start_ms, end_ms""", using=("filled_sentences",))
def merge_equal_sentences(spark, sf_dir):
    merged = wd.merge_equal_sentences(wd.interpolate_sentences(_sentences(spark, sf_dir)))
    return merged.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


NULL_SEG = "recording_id, segment_idx"
for _method in wd.METHODS:
    def _interp(spark, sf_dir, method=_method):
        words = corpus.null_words(corpus.words(corpus.utterances(spark, sf_dir)))
        return words.withColumns({c: wd.interpolated(c, "pos", wd.SEGMENT, method) for c in ("start_ms", "end_ms")})

    query(f"interp_{_method}", "SELECT recording_id, segment_idx, pos, word, start_ms, end_ms FROM (" + interpolation_sql(
        "null_words", NULL_SEG, "pos", f"{NULL_SEG}, pos, word", _method) + ")", using=("null_words",))(_interp)


@query("word_interp", "WITH f AS (" + interpolation_sql(
    "rolled_words", f"{SEG}, sentence_idx", "word_idx",
    f"{SEG}, sentence_idx, word_idx, word, score, start_ms AS s0, end_ms AS e0", "nearest") + """)
    SELECT recording_id, segment_idx, sentence_idx, word_idx, word, score,
      CASE WHEN n_known > 0 AND n_known < n_all THEN start_ms ELSE s0 END AS start_ms,
      CASE WHEN n_known > 0 AND n_known < n_all THEN end_ms ELSE e0 END AS end_ms FROM f""", using=("rolled_words",))
def word_interp(spark, sf_dir):
    words = wd.word_rollup(wd.timed_sentences(timed_segments(spark, sf_dir)))
    return wd.interpolate_words(words, [*wd.SEGMENT, "sentence_idx"])
