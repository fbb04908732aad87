"""Linguistic subtitle splitting: estimated word times, split points at commas and conjunctions, fragments."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from speechloom.functions.fixed_values import (
    COMMAS, COMPLEX_SCRIPT_LANGUAGES, CONJUNCTIONS, DEFAULT_COMMA,
)
from speechloom.functions.text import joiner, spaceless
from speechloom.operators.cues import SEGMENT
from speechloom.params import SplitLimits
from speechloom.plans.lookups import literal_map

Lists = Mapping[str, Sequence[str]]
MS_PER_LETTER = 250
CLOSE_GAP_MS = 800


def script_limits(lang: Column, limits: SplitLimits = SplitLimits()) -> tuple[Column, Column]:
    """Longest line and shortest part for the script of a language."""
    dense = F.coalesce(lang.isin(*COMPLEX_SCRIPT_LANGUAGES), F.lit(False))
    return (F.when(dense, limits.complex_max_line).otherwise(limits.max_line),
            F.when(dense, limits.complex_min_chars).otherwise(limits.min_chars))


def comma(lang: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(COMMAS), lang), F.lit(DEFAULT_COMMA))


def is_conjunction(word: Column, lang: Column, lists: Lists = CONJUNCTIONS) -> Column:
    """Membership in the language's list; a language without a list has none."""
    out = F.lit(False)
    for code, words in lists.items():
        out = F.when(lang == code, F.lower(word).isin(*words)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def estimate_word_times(words: DataFrame) -> DataFrame:
    """Times for words lacking a start or an end, from the neighbours, the next segment or the word's length.

    ``words``: ``recording_id, segment_idx, pos, word, start_ms, end_ms, next_start_ms`` (start of the following
    segment). A missing word begins where its predecessor ends. It ends where the next word starts, else shortly
    before or at the next segment, else after 250 ms per letter. Predecessors may be estimates themselves; since
    such chains only pass a known end, a reached segment start or a sum of lengths along, they are written as
    window values over the segment.
    """
    seg = Window.partitionBy(*SEGMENT).orderBy("pos")
    before = seg.rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.col("next_start_ms")
    marked = words.withColumns({
        "_gap": F.col("start_ms").isNull() | F.col("end_ms").isNull(),
        "_follow": F.lead("start_ms").over(seg),
        "_first": F.lag(F.lit(1)).over(seg).isNull(),
        "_size": F.length("word") * MS_PER_LETTER,
    })
    # Ends that do not depend on an estimated predecessor.
    settled = (
        F.when(~F.col("_gap"), F.col("end_ms"))
        .when(F.col("_follow").isNotNull(), F.col("_follow"))
        .when(F.col("_first"), F.coalesce(nxt - 500, F.lit(0)))
    )
    marked = marked.withColumn("_end", settled.cast("bigint"))
    drift = F.sum(F.when(F.col("_end").isNull(), F.col("_size")).otherwise(0)).over(
        seg.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = marked.withColumn("_drift", drift)
    marked = marked.withColumns({
        "_base": F.last(F.when(F.col("_end").isNotNull(), F.struct("_end", "_drift")), ignorenulls=True).over(before),
        "_prev_end": F.lag("_end").over(seg),
    })
    to_segment = F.when(F.col("_prev_end").isNull() | (nxt - F.col("_prev_end") <= 1000), nxt).otherwise(nxt - 500)
    by_length = F.col("_base._end") + F.col("_drift") - F.col("_base._drift")
    # After a first word placed against the next segment, that segment's start is at most half a second away.
    ended = marked.withColumn(
        "_done", F.coalesce(F.col("_end"), F.when(nxt.isNotNull(), to_segment).otherwise(by_length)).cast("bigint"))
    begun = (
        F.when(~F.col("_gap"), F.col("start_ms"))
        .when(~F.col("_first"), F.lag("_done").over(seg))
        .when(F.col("_follow").isNotNull(), F.col("_follow") - F.col("_size"))
        .otherwise(F.coalesce(nxt - 1000, F.lit(0)))
    )
    out = ended.withColumn("_begun", begun.cast("bigint"))
    return out.select(*[
        F.col("_begun").alias(c) if c == "start_ms" else F.col("_done").alias(c) if c == "end_ms" else F.col(c)
        for c in words.columns])


def cut_positions(
    sizes: Sequence[int], gap: int, in_totals: bool, commas: Sequence[bool], conjunctions: Sequence[bool],
    longest: int, shortest: int,
) -> list[int]:
    """Index of the last word of every part but the final one.

    All widths are prefix sums, so the next cut is found by bisection instead of by walking the words: the
    earliest sign (a comma behind a word, a conjunction in front of one) that leaves at least ``shortest`` on both sides
    and comes before the line is full, else the word with which the line is full and long enough.
    """
    wide = [0, *accumulate(n + gap for n in sizes)]
    whole = wide if in_totals else [0, *accumulate(sizes)]
    signs = [i for i, (c, j) in enumerate(zip(commas, conjunctions)) if c or j]
    last_sign = bisect_right(wide, whole[-1] - shortest) - 2
    found, begin, part, zero = [], 0, 0, 0
    while True:
        full = max(begin, bisect_left(wide, zero + longest) - 1)
        ready = max(begin, bisect_left(wide, zero + shortest))
        at = bisect_left(signs, ready)
        if at < len(signs) and signs[at] < full and signs[at] <= last_sign:
            sign = signs[at]
            part = sign + 1 if commas[sign] else sign
            found.append(part - 1)
            zero, begin = wide[part], sign + 1
            continue
        over = max(full, ready)
        if over >= len(sizes):
            return found
        middle = (part + over + 1) // 2
        found.append(middle)
        part, begin = middle + 1, over + 1
        zero = wide[begin] - (whole[begin] - whole[part] if part < begin else 0)


@F.pandas_udf(ArrayType(IntegerType()))
def split_points(
    sizes: pd.Series, separator: pd.Series, in_totals: pd.Series, commas: pd.Series, conjunctions: pd.Series,
    longest: pd.Series, shortest: pd.Series,
) -> pd.Series:
    """``cut_positions`` of every row.

    ``separator`` is the width of the sign between words; ``in_totals`` tells whether sums over words count it.
    """
    return pd.Series([cut_positions([int(n) for n in row[0]], int(row[1]), bool(row[2]), *row[3:])
                      for row in zip(sizes, separator, in_totals, commas, conjunctions, longest, shortest)])


def with_split_points(
    nested: DataFrame, timed: bool, limits: SplitLimits = SplitLimits(), lists: Lists = CONJUNCTIONS,
) -> DataFrame:
    """Add ``splits`` to segments with ``words array<struct<word,...>>`` and ``lang``."""
    lang = F.col("lang")
    longest, shortest = script_limits(lang, limits)
    word = lambda f: F.transform("words", lambda w: f(w["word"]))
    return nested.withColumn("splits", split_points(
        word(F.length), F.when(spaceless(lang), 0).otherwise(1), F.lit(not timed),
        word(lambda w: w.endswith(comma(lang))), word(lambda w: is_conjunction(w, lang, lists)), longest, shortest))


def _fragments(split: DataFrame) -> DataFrame:
    """One row per part of a segment: ``frag``, its ``words`` and the word behind it."""
    count = F.size("words")
    firsts = F.concat(F.array(F.lit(0)), F.transform("splits", lambda p: p + 1))
    lasts = F.concat("splits", F.array(count - 1))
    bounds = F.filter(
        F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] <= x["b"])
    keep = [c for c in split.columns if c not in ("words", "splits")]
    return split.select(*keep, "words", count.alias("n_words"), F.posexplode(bounds).alias("frag", "_x")).select(
        *keep, "n_words", "frag", F.col("_x.a").alias("first"), F.col("_x.b").alias("last"),
        F.slice("words", F.col("_x.a") + 1, F.col("_x.b") - F.col("_x.a") + 1).alias("words"),
        F.get("words", F.col("_x.b") + 1).alias("_behind"))


def _joined(words: Column, lang: Column) -> Column:
    texts = F.transform(words, lambda w: w["word"])
    return F.when(joiner(lang) == "", F.array_join(texts, "")).otherwise(F.array_join(texts, " "))


def _stretched(end: Column, following: Column) -> Column:
    """Close a short gap up to what follows."""
    return F.when(following - end <= CLOSE_GAP_MS, following).otherwise(end)


def split_timed(nested: DataFrame, limits: SplitLimits = SplitLimits(), lists: Lists = CONJUNCTIONS) -> DataFrame:
    """Fragments of segments whose words have times (see ``estimate_word_times``).

    ``nested`` also carries ``next_start_ms``. Returns ``frag, start_ms, end_ms, text``.
    """
    parts = _fragments(with_split_points(nested, True, limits, lists))
    end = F.element_at("words", -1)["end_ms"]
    follows = F.coalesce(F.col("_behind.start_ms"), F.when(F.col("_behind").isNull(), F.col("next_start_ms")))
    return parts.select(
        *SEGMENT, "frag", F.element_at("words", 1)["start_ms"].alias("start_ms"),
        F.coalesce(_stretched(end, follows), end, "end_ms").alias("end_ms"),
        _joined(F.col("words"), F.col("lang")).alias("text"))


def split_plain(segments: DataFrame, limits: SplitLimits = SplitLimits(), lists: Lists = CONJUNCTIONS) -> DataFrame:
    """Fragments of segments without words: the text is cut at whitespace, time shared out by word count."""
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    nested = segments.withColumn("words", F.transform(words, lambda w: F.struct(w.alias("word")))).filter(
        F.size("words") > 0)
    parts = _fragments(with_split_points(nested, False, limits, lists))
    length = F.col("end_ms") - F.col("start_ms")
    at = lambda n: (F.col("start_ms") + F.rint(length * n / F.col("n_words"))).cast("bigint")
    end = at(F.col("last") + 1)
    final = F.col("last") + 1 == F.col("n_words")
    return parts.select(
        *SEGMENT, "frag", at(F.col("first")).alias("start_ms"),
        F.coalesce(F.when(final, _stretched(end, F.col("next_start_ms"))), end).alias("end_ms"),
        _joined(F.col("words"), F.col("lang")).alias("text"))


def plain_subtitles(segments: DataFrame) -> DataFrame:
    """One subtitle per segment, unsplit."""
    return segments.select(*SEGMENT, "start_ms", "end_ms", "text")
