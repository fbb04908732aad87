"""Text helpers."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from speechloom.functions.fixed_values import LANGUAGES_WITHOUT_SPACES


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def spaceless(lang: Column) -> Column:
    """True for languages written without spaces between words."""
    return F.coalesce(lang.isin(*LANGUAGES_WITHOUT_SPACES), F.lit(False))


def joiner(lang: Column) -> Column:
    return F.when(spaceless(lang), F.lit("")).otherwise(F.lit(" "))


def characters(text: Column) -> Column:
    """Code points of a text, in order; the empty text has none."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def running_starts(text: Column) -> Column:
    """Character offset of every blank-separated word: positions right after each blank, first 0.

    Linear, because positions of the blanks are read off the character array.
    """
    marks = F.transform(characters(text), lambda c, i: F.when(c == " ", i + 1).otherwise(0))
    return F.concat(F.array(F.lit(0)), F.array_remove(marks, 0))


def words_with_offsets(text: Column) -> Column:
    """``array<struct<word, offset>>`` of the blank-separated words."""
    return F.zip_with(
        F.split(text, " ", -1), running_starts(text),
        lambda w, o: F.struct(w.alias("word"), o.cast("int").alias("offset")),
    )


def cue_text(text: Column) -> Column:
    """Stripped text that cannot be taken for a cue arrow."""
    return F.replace(strip(text), F.lit("-->"), F.lit("->"))


def one_line(text: Column) -> Column:
    """Stripped text with tabs turned into blanks, for tab-separated output."""
    return F.translate(strip(text), "\t", " ")


def speaker_prefix(speaker: Column) -> Column:
    return F.when(speaker.isNotNull(), F.concat(F.lit("["), speaker, F.lit("]: "))).otherwise(F.lit(""))


def label_prefix(speaker: Column) -> Column:
    return F.when(speaker.isNotNull(), F.concat(F.lit("[["), speaker, F.lit("]]"))).otherwise(F.lit(""))


def underline(word: Column) -> Column:
    """Wrap a word in ``<u>`` behind its leading whitespace."""
    return F.regexp_replace(word, r"^(\s*)(.*)$", "$1<u>$2</u>")


def json_string(text: Column) -> Column:
    """A JSON string literal."""
    doc = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(doc, F.lit(6), F.length(doc) - 6))


@F.pandas_udf(DoubleType())
def compression_ratio(texts: pd.Series) -> pd.Series:
    """UTF-8 size over deflated size; deflate is not an expression Spark has."""
    raw = texts.str.encode("utf-8")
    return pd.Series([None if b is None else len(b) / len(zlib.compress(b)) for b in raw], dtype="float64")
