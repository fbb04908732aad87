"""Rule-based sentence spans: a run of full stops, exclamation or question marks before whitespace ends one."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from speechloom.functions.fixed_values import ABBREVIATIONS
from speechloom.functions.text import characters, strip

# Private-use signs put into the text while it is cut; such signs in the input count as blanks.
OPEN, CLOSE, DOT = "", "", ""


def _marked(text: Column) -> Column:
    body = strip(F.translate(text, OPEN + CLOSE + DOT, "   "))
    shielded = F.regexp_replace(body, r"\b(" + "|".join(ABBREVIATIONS) + r")\.(\s)", f"$1{DOT}$2")
    cut = F.regexp_replace(shielded, r"([.!?]+)(\s+)", f"$1{CLOSE}$2{OPEN}")
    return F.concat(F.lit(OPEN), cut, F.lit(CLOSE))


def sentence_spans(text: Column) -> Column:
    """``array<struct<s_start, s_end, sentence>>`` with half-open character offsets, whitespace between left out.

    Offsets are read off the positions of the marks, so the work grows linearly with the text.
    """
    marked = _marked(text)
    lead = F.length(text) - F.length(F.regexp_replace(text, r"(?U)^\s+", ""))
    # Marks open and close in turn; each stands behind those before it.
    marks = F.array_remove(F.transform(characters(marked), lambda c, i: F.when((c == OPEN) | (c == CLOSE), i).otherwise(-1)), -1)
    pieces = F.split(marked, f"[{OPEN}{CLOSE}]")
    cut = F.filter(F.transform(F.arrays_zip(marks.alias("m"), F.slice(pieces, 2, F.size(pieces)).alias("p")), lambda z, k: F.when(
        k % 2 == 0, F.struct((z["m"] - k + lead).cast("int").alias("s_start"), F.length(z["p"]).alias("n"),
                             F.replace(z["p"], F.lit(DOT), F.lit(".")).alias("sentence")))), lambda s: s.isNotNull())
    spans = F.transform(cut, lambda s: F.struct(s["s_start"], (s["s_start"] + s["n"]).alias("s_end"), s["sentence"]))
    return F.when(strip(text) != "", spans).otherwise(
        F.array().cast("array<struct<s_start:int,s_end:int,sentence:string>>"))
