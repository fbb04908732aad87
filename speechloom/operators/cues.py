"""Subtitle cues: grouping of words, cue times, pauses, highlighting.

A *nested segment* row is ``recording_id, segment_idx, speaker, lang, text, start_ms, end_ms`` with
``words array<struct<word,start_ms,end_ms>>``; its words are bounded by the segment's own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from speechloom.functions.text import cue_text, joiner, speaker_prefix, strip, underline
from speechloom.params import CueLimits
from speechloom.plans.blocks import Scan, blocked_scan, chained_annotation, index_block, shuffle_width

SEGMENT = ["recording_id", "segment_idx"]
SEGMENTS_PER_BLOCK = 4096


def nest_words(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Attach the words of a flat table to their segments, in order; segments without words get an empty list.

    A transcript that was never aligned has null instead of lists; see ``transcript_cues``.
    """
    lists = words.groupBy(*SEGMENT).agg(
        F.sort_array(F.collect_list(F.struct("pos", "word", "start_ms", "end_ms"))).alias("_w"))
    nested = F.transform(F.coalesce("_w", F.array().cast("array<struct<pos:int,word:string,start_ms:bigint,end_ms:bigint>>")),
                         lambda w: F.struct(w["word"].alias("word"), w["start_ms"].alias("start_ms"),
                                            w["end_ms"].alias("end_ms")))
    return segments.join(lists, SEGMENT, "left").withColumn("words", nested).drop("_w")


def long_pauses(words: DataFrame, pause_ms: int = 3000) -> DataFrame:
    """Flag words that start more than ``pause_ms`` after the latest known start of the recording."""
    seen = blocked_scan(
        words.select(*SEGMENT, "pos", "word", "start_ms"), ["recording_id"],
        index_block("segment_idx", SEGMENTS_PER_BLOCK), ["segment_idx", "pos"],
        [Scan("prev_start_ms", "prev", F.col("start_ms"))])
    return seen.withColumn(
        "long_pause", F.coalesce(F.col("start_ms") - F.col("prev_start_ms") > pause_ms, F.lit(False)))


def cue_times(words: Column, seg_start: Column, seg_end: Column) -> tuple[Column, Column]:
    """First known word start and last known word end if there is one of each, else the segment's times."""
    start = F.array_min(F.transform(words, lambda w: w["start_ms"]))
    end = F.array_max(F.transform(words, lambda w: w["end_ms"]))
    both = start.isNotNull() & end.isNotNull()
    return F.when(both, start).otherwise(seg_start), F.when(both, end).otherwise(seg_end)


def _laid(words: Column, width: int) -> Column:
    """The words as they are shown in lines of at most ``width`` characters, blanks between words not counted.

    A word that opens a line is stripped, and all but the first carry the line break in front.
    """
    shown = lambda w, text: F.struct(text.alias("word"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"))
    kind = "array<struct<word:string,start_ms:bigint,end_ms:bigint>>"
    start = F.struct(F.lit(0).alias("n"), F.array().cast(kind).alias("done"))

    def add(acc: Column, w: Column) -> Column:
        word, fresh = w["word"], w["fresh"]
        fits = (acc["n"] > 0) & (acc["n"] + F.length(word) <= width)
        opened = F.when(acc["n"] > 0, F.concat(F.lit("\n"), fresh)).otherwise(fresh)
        return F.struct(F.when(fits, acc["n"] + F.length(word)).otherwise(F.length(fresh)).alias("n"),
                        F.array_append(acc["done"], shown(w, F.when(fits, word).otherwise(opened))).alias("done"))

    stripped = F.transform(words, lambda w: F.struct(w["word"], strip(w["word"]).alias("fresh"), w["start_ms"], w["end_ms"]))
    return F.aggregate(stripped, start, add, lambda acc: acc["done"])


def _body(words: Column, lang: Column) -> Column:
    texts = F.transform(words, lambda w: w["word"])
    return F.when(joiner(lang) == "", F.array_join(texts, "")).otherwise(F.array_join(texts, " "))


def cues_by_segment(nested: DataFrame, limits: CueLimits = CueLimits()) -> DataFrame:
    """One cue per segment that has words, a row operation.

    ``recording_id, segment_idx, start_ms, end_ms, text``, and ``words`` (as shown), ``speaker, lang`` for highlighting.
    """
    if limits.max_line_count is not None:
        raise ValueError("a line count may break segments apart: use cues_limited")
    start, end = cue_times(F.col("words"), F.col("start_ms"), F.col("end_ms"))
    laid = nested.filter(F.size("words") > 0).withColumn("_laid", _laid(F.col("words"), limits.width))
    return laid.select(
        *SEGMENT, start.alias("start_ms"), end.alias("end_ms"),
        F.concat(speaker_prefix(F.col("speaker")), _body(F.col("_laid"), F.col("lang"))).alias("text"),
        F.col("_laid").alias("words"), "speaker", "lang")


BREAKS = StructType([StructField("new_line", IntegerType()), StructField("new_cue", IntegerType())])


def cues_limited(nested: DataFrame, limits: CueLimits, segments_per_block: int = SEGMENTS_PER_BLOCK) -> DataFrame:
    """Cues of at most ``max_line_count`` lines of ``max_line_width`` characters, also broken at long pauses.

    Without a width, cues additionally end with their segment and pauses are not looked at.

    Where a line ends depends on all before it, so a fold over the words of a recording marks the breaks; it runs
    block by block. Numbering and gathering of the cues are ordinary scans and groupings.
    """
    if limits.max_line_count is None:
        raise ValueError("without a line count cues follow segments: use cues_by_segment")
    flat = nested.select(
        *SEGMENT, "speaker", "lang", F.col("start_ms").alias("seg_start"), F.col("end_ms").alias("seg_end"),
        F.posexplode("words").alias("pos", "_w")).select(
        *SEGMENT, "pos", "speaker", "lang", "seg_start", "seg_end", F.col("_w.word").alias("word"),
        F.col("_w.start_ms").alias("start_ms"), F.col("_w.end_ms").alias("end_ms"))
    sized = flat.withColumns({"n": F.length("word"), "n_bare": F.length(strip(F.col("word")))})
    marked = chained_annotation(
        sized, ["recording_id"], index_block("segment_idx", segments_per_block), ["segment_idx", "pos"],
        _breaker(limits), ["pos", "n", "n_bare", "start_ms"], BREAKS).drop("n", "n_bare")
    numbered = blocked_scan(marked, ["recording_id"], index_block("segment_idx", segments_per_block),
                            ["segment_idx", "pos"], [Scan("_cue", "sum", F.col("new_cue"))])
    shown = F.when(F.col("new_line") == 1, F.concat(F.lit("\n"), strip(F.col("word")))).when(
        F.col("new_line") == 0, F.col("word")).otherwise(strip(F.col("word")))
    entry = F.struct("segment_idx", "pos", shown.alias("word"), "start_ms", "end_ms")
    first = F.struct("segment_idx", "pos")
    cues = numbered.groupBy("recording_id", (F.col("_cue") - 1).cast("bigint").alias("cue_idx")).agg(
        F.sort_array(F.collect_list(entry)).alias("words"),
        F.min_by(F.struct("speaker", "lang", "seg_start", "seg_end"), first).alias("_f"))
    start, end = cue_times(F.col("words"), F.col("_f.seg_start"), F.col("_f.seg_end"))
    body = _body(F.col("words"), F.col("_f.lang"))
    return cues.select("recording_id", "cue_idx", start.alias("start_ms"), end.alias("end_ms"),
                       F.concat(speaker_prefix(F.col("_f.speaker")), body).alias("text"), "words",
                       F.col("_f.speaker").alias("speaker"), F.col("_f.lang").alias("lang"))


def cues(nested: DataFrame, limits: CueLimits = CueLimits()) -> DataFrame:
    """Cues with ``cue_idx`` increasing in time, under any limits."""
    if limits.max_line_count is not None:
        return cues_limited(nested, limits)
    return cues_by_segment(nested, limits).withColumnRenamed("segment_idx", "cue_idx")


def transcript_cues(nested: DataFrame, limits: CueLimits = CueLimits(), highlight: bool = False) -> DataFrame:
    """``recording_id, cue_idx, step, start_ms, end_ms, text`` of whole transcripts.

    The first segment of a recording decides: with a word list (an empty one included) cues are made of words, without one
    (null ``words``) every segment is a cue of its own text. ``highlight`` underlines each word while it is spoken.
    """
    decided = nested.groupBy("recording_id").agg(
        F.min_by(F.col("words").isNotNull(), "segment_idx").alias("_worded"))
    placed = nested.join(decided, "recording_id")
    if highlight:
        # Underlining writes every cue out once per word: rows go to all tasks, where coalescing would weigh those before it.
        placed = placed.repartition(shuffle_width(nested), *SEGMENT)
    made = cues(placed.filter("_worded").drop("_worded"), limits)
    kept = ["recording_id", "cue_idx", "step", "start_ms", "end_ms", "text"]
    made = highlight_cues(made) if highlight else made.withColumn("step", F.lit(0))
    plain = segment_cues(placed.filter(~F.col("_worded"))).withColumnRenamed("segment_idx", "cue_idx").withColumn("step", F.lit(0))
    return made.select(*kept).unionByName(plain.select(*kept))


def _breaker(limits: CueLimits):
    """Fold that marks, per word, a new cue (1) and a line start: 0 none, 1 behind a line break, 2 first in a cue."""
    width, count, pause, keep = limits.width, limits.max_line_count, limits.long_pause_ms, limits.by_segment

    def mark(state, rows: dict[str, list], final: bool):
        used, lines, filled, seen = state or (0, 1, False, None)
        line_marks, cue_marks = [], []
        for pos, n, bare, start in zip(rows["pos"], rows["n"], rows["n_bare"], rows["start_ms"]):
            paused = not keep and start is not None and seen is not None and start - seen > pause
            leaves = keep and filled and pos == 0
            if used > 0 and used + n <= width and not paused and not leaves:
                used += n
                line, cue = 0, 0
            else:
                cue = int(not filled or paused or leaves or lines >= count)
                line = 2 if cue or used == 0 else 1
                lines = 1 if cue else lines + (line == 1)
                used = bare
            filled = True
            seen = seen if start is None else start
            line_marks.append(line)
            cue_marks.append(cue)
        return {"new_line": line_marks, "new_cue": cue_marks}, [used, lines, filled, seen]

    return mark


def highlight_cues(cues: DataFrame) -> DataFrame:
    """Expand cues so that each timed word is underlined while spoken, with a plain cue in every gap.

    Takes ``start_ms, end_ms, text, words`` plus ``lang`` and ``speaker``; cues without timed words stay as they
    are. ``step`` orders the parts of a cue. A word without an end ends when it starts.
    """
    keep = [c for c in cues.columns if c not in ("start_ms", "end_ms", "text", "words", "speaker", "lang")]
    prefix = speaker_prefix(F.col("speaker"))
    glue = joiner(F.col("lang"))
    every = F.transform("words", lambda w, i: F.struct(
        i.alias("i"), w["word"].alias("word"), w["start_ms"].alias("s"),
        F.coalesce(w["end_ms"], w["start_ms"]).alias("e")))
    timed = F.filter(every, lambda w: w["s"].isNotNull())
    earlier = F.concat(F.array("start_ms"), F.transform(timed, lambda w: w["e"]))
    spoken = F.filter(F.zip_with(timed, earlier, lambda w, last: F.struct(
        w["i"].alias("i"), w["s"].alias("s"), w["e"].alias("e"), last.alias("last"))), lambda x: x["i"].isNotNull())
    exploded = cues.select(*keep, "start_ms", "end_ms", "text", "words", prefix.alias("_prefix"),
                           glue.alias("_glue"), F.posexplode_outer(spoken).alias("_k", "_t"))
    shown, i = F.col("words.word"), F.col("_t.i")
    words = F.concat(F.slice(shown, F.lit(1), i), F.array(underline(F.get(shown, i))), F.slice(shown, i + 2, F.size(shown)))
    # A column of its own: inside of the explode below it would be interpreted.
    exploded = exploded.withColumn("_lit", F.concat("_prefix", F.when(F.col("_glue") == "", F.array_join(words, "")).otherwise(
        F.array_join(words, " "))))
    k = F.col("_k")
    gap = F.when(F.col("_t.last") != F.col("_t.s"), F.struct(
        (2 * k).alias("step"), F.col("_t.last").alias("start_ms"), F.col("_t.s").alias("end_ms"), F.col("text")))
    word = F.struct((2 * k + 1).alias("step"), F.col("_t.s").alias("start_ms"), F.col("_t.e").alias("end_ms"),
                    F.col("_lit").alias("text"))
    plain = F.struct(F.lit(0).alias("step"), "start_ms", "end_ms", "text")
    parts = F.when(k.isNull(), F.array(plain)).when(gap.isNull(), F.array(word)).otherwise(F.array(gap, word))
    return exploded.select(*keep, F.explode(parts).alias("_p")).select(*keep, "_p.*")


def segment_cues(segments: DataFrame) -> DataFrame:
    """Plain cues of segments without word lists."""
    return segments.select(
        *SEGMENT, "start_ms", "end_ms",
        F.concat(speaker_prefix(F.col("speaker")), cue_text(F.col("text"))).alias("text"))


def number_cues(cues: DataFrame, order: list[str]) -> DataFrame:
    """1-based counter per recording along ``order`` (first the segment or cue index)."""
    numbered = blocked_scan(cues, ["recording_id"], index_block(order[0], SEGMENTS_PER_BLOCK), order,
                            [Scan("_n", "sum", F.lit(1))])
    return numbered.withColumn("number", F.col("_n").cast("bigint")).drop("_n")


def next_segment_start(segments: DataFrame) -> DataFrame:
    """Start of the following segment of the recording, as ``next_start_ms``."""
    return blocked_scan(segments, ["recording_id"], index_block("segment_idx", SEGMENTS_PER_BLOCK), ["segment_idx"],
                        [Scan("next_start_ms", "next", F.col("start_ms"))])
