"""Transcript files: every format is a table of ordered lines, written once per recording.

A *lines* table is ``recording_id, ord array<bigint>, line``; ``ord`` sorts the lines of a recording's file. A
``line`` may hold several text lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from speechloom.functions.text import json_string, label_prefix, one_line, speaker_prefix, strip
from speechloom.functions.time import format_ms, seconds_text, seconds_to_ms
from speechloom.operators import cues as cu
from speechloom.params import CueLimits

LineMaker = Callable[[DataFrame], DataFrame]


def _lines(df: DataFrame, order: list, line: Column) -> DataFrame:
    return df.select("recording_id", F.array(*[F.lit(o).cast("bigint") if isinstance(o, int) else F.col(o).cast("bigint")
                                               for o in order]).alias("ord"), line.alias("line"))


def _once(df: DataFrame, order: list[int], line: str) -> DataFrame:
    """One fixed line per recording."""
    return _lines(df.select("recording_id").distinct(), order, F.lit(line))


def txt_lines(segments: DataFrame) -> DataFrame:
    return _lines(segments, ["segment_idx"], F.concat(speaker_prefix(F.col("speaker")), strip(F.col("text"))))


def tsv_lines(segments: DataFrame) -> DataFrame:
    body = F.concat_ws("\t", F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), one_line(F.col("text")))
    return _once(segments, [-1], "start\tend\ttext").unionByName(_lines(segments, ["segment_idx"], body))


def label_lines(segments: DataFrame) -> DataFrame:
    """Label track of an audio editor: seconds, no header."""
    body = F.concat(seconds_text(F.col("start_ms")), F.lit("\t"), seconds_text(F.col("end_ms")), F.lit("\t"),
                    label_prefix(F.col("speaker")), one_line(F.col("text")))
    return _lines(segments, ["segment_idx"], body)


def _arrow(always_hours: bool, marker: str) -> Column:
    return F.concat(format_ms(F.col("start_ms"), always_hours, marker), F.lit(" --> "),
                    format_ms(F.col("end_ms"), always_hours, marker))


def srt_lines(cues: DataFrame, order: list[str]) -> DataFrame:
    """Numbered cues with hours and comma, a blank line after each."""
    numbered = cu.number_cues(cues.select("recording_id", *order, "start_ms", "end_ms", "text"), order)
    return _lines(numbered, ["number"], F.concat_ws(
        "\n", F.col("number").cast("string"), _arrow(True, ","), F.concat("text", F.lit("\n"))))


def vtt_lines(cues: DataFrame, order: list[str], recordings: DataFrame | None = None) -> DataFrame:
    """Cues without numbers under a header, hours only when needed."""
    body = _lines(cues, order, F.concat_ws("\n", _arrow(False, "."), F.concat("text", F.lit("\n"))))
    head = _once(cues if recordings is None else recordings, [-1] * len(order), "WEBVTT\n")
    return head.unionByName(body)


def split_lines(fragments: DataFrame, is_vtt: bool = False) -> DataFrame:
    """File of split subtitles: always numbered, hours always shown, header only for VTT.

    A first word estimated backwards may begin before the recording does; it is written as 0, so that one such
    word does not fail the job.
    """
    order = ["segment_idx", "frag"]
    shown = [F.greatest(F.col(c), F.lit(0)).alias(c) for c in ("start_ms", "end_ms")]
    numbered = cu.number_cues(fragments.select("recording_id", *order, *shown, "text"), order)
    body = _lines(numbered, ["number"], F.concat_ws(
        "\n", F.col("number").cast("string"), _arrow(True, "." if is_vtt else ","),
        F.concat(strip(F.col("text")), F.lit("\n"))))
    return _once(fragments, [-1], "WEBVTT\n").unionByName(body) if is_vtt else body


def _field(name: str, value: Column) -> Column:
    """``"name": value``, or null (the key is left out) where the value is unknown."""
    return F.concat(F.lit(f'"{name}": '), value)


def _object(*fields: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))


def _text_field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), _field(name, json_string(value)))


def _timed_json(name: str, names: list[str]) -> Callable[[Column], Column]:
    """JSON of a word or character; its score and speaker appear if the table has them."""

    def doc(w: Column) -> Column:
        fields = [_text_field(name, w[name]), _field("start", seconds_text(w["start_ms"])),
                  _field("end", seconds_text(w["end_ms"]))]
        if "score" in names:
            fields.append(_field("score", seconds_text(seconds_to_ms(w["score"]))))
        if "speaker" in names:
            fields.append(_text_field("speaker", w["speaker"]))
        return _object(*fields)

    return doc


def json_lines(nested: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """One JSON document per recording, spread over lines: a document is never held whole by a task.

    Unknown values have no key. ``avg_logprob`` and ``chars`` columns add a segment's log-probability and aligned characters, ``embeddings`` (recording_id, speaker, embedding) adds ``speaker_embeddings``.
    """
    word_json = _timed_json("word", nested.schema["words"].dataType.elementType.names)
    words = F.array_join(F.transform("words", word_json), ", ")
    chars = []
    if "chars" in nested.columns:
        char_json = _timed_json("char", nested.schema["chars"].dataType.elementType.names)
        chars = [F.concat(F.lit('"chars": ['), F.array_join(F.transform("chars", char_json), ", "), F.lit("]"))]
    rated = [_field("avg_logprob", F.col("avg_logprob").cast("string"))] if "avg_logprob" in nested.columns else []
    segment = _object(
        _field("start", seconds_text(F.col("start_ms"))), _field("end", seconds_text(F.col("end_ms"))),
        _text_field("text", F.col("text")), F.concat(F.lit('"words": ['), words, F.lit("]")),
        *rated, *chars, _text_field("speaker", F.col("speaker")))
    flat = nested.select("recording_id", "segment_idx", F.posexplode("words").alias("pos", "_w"))
    word_rows = flat.select("recording_id", "segment_idx", "pos", word_json(F.col("_w")).alias("doc"))
    parts = [
        _once(nested, [0, 0, 0], '{"segments": ['),
        _listed(nested.select("recording_id", "segment_idx", F.lit(0).alias("pos"), segment.alias("doc")), 1),
        _once(nested, [2, 0, 0], '], "word_segments": ['),
        _listed(word_rows, 3),
    ]
    if embeddings is not None:
        parts.append(_once(nested, [4, 0, 0], '], "speaker_embeddings": {'))
        rows = embeddings.select("recording_id", F.concat(
            json_string(F.col("speaker")), F.lit(": "), F.to_json("embedding")).alias("doc"),
            F.dense_rank().over(_speaker_window()).cast("bigint").alias("segment_idx"), F.lit(0).alias("pos"))
        parts.append(_listed(rows, 5))
    tail = nested.groupBy("recording_id").agg(F.first("lang", ignorenulls=True).alias("lang"))
    close = "}, " if embeddings is not None else "], "
    parts.append(_lines(tail, [6, 0, 0], F.concat(
        F.lit(close), F.lit('"language": '), json_string(F.col("lang")), F.lit("}"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _speaker_window():
    from pyspark.sql import Window

    return Window.partitionBy("recording_id").orderBy("speaker")


def _listed(rows: DataFrame, section: int) -> DataFrame:
    """Elements of a JSON list; all but the first of a recording are led by a comma.

    The first element is found by its whole key, so that joining the mark spreads like the elements themselves.
    """
    key = ["recording_id", "segment_idx", "pos"]
    first = rows.groupBy("recording_id").agg(F.min(F.struct("segment_idx", "pos")).alias("f")).select(
        "recording_id", "f.*", F.lit("").alias("_lead"))
    joined = rows.join(first, key, "left")
    return _lines(joined, [section, "segment_idx", "pos"], F.concat(F.coalesce("_lead", F.lit(", ")), "doc"))


# Formats by name; "all" stands for every one but the label track, which is written only on request.
WRITERS: dict[str, LineMaker] = {
    "txt": txt_lines,
    "vtt": lambda nested: subtitle_writers()["vtt"](nested),
    "srt": lambda nested: subtitle_writers()["srt"](nested),
    "tsv": tsv_lines,
    "json": lambda nested: json_lines(nested.withColumn("words", F.coalesce("words", F.array()))),
}
OPTIONAL_WRITERS: dict[str, LineMaker] = {"aud": label_lines}
ORDER = ["cue_idx", "step"]


def subtitle_writers(limits: CueLimits = CueLimits(), highlight: bool = False) -> dict[str, LineMaker]:
    """The formats that show cues, with a layout and with or without underlined words."""
    cues = lambda nested: cu.transcript_cues(nested, limits, highlight)
    return {"vtt": lambda nested: vtt_lines(cues(nested), ORDER, nested), "srt": lambda nested: srt_lines(cues(nested), ORDER)}


def writers_for(output_format: str, limits: CueLimits = CueLimits(), highlight: bool = False) -> dict[str, LineMaker]:
    """The chosen formats; ``limits`` and ``highlight`` shape the subtitles among them."""
    writers = {**WRITERS, **subtitle_writers(limits, highlight)}
    if output_format == "all":
        return writers
    known = {**writers, **OPTIONAL_WRITERS}
    if output_format not in known:
        raise ValueError(f"unknown output format {output_format}")
    return {output_format: known[output_format]}


def register_writer(name: str, make: LineMaker) -> None:
    """Add a format of your own: a function from nested segments to a lines table."""
    OPTIONAL_WRITERS[name] = make


def fan_out(
    nested: DataFrame, output_format: str = "all", limits: CueLimits = CueLimits(), highlight: bool = False,
) -> DataFrame:
    """Lines of all chosen formats with their ``format``."""
    out = None
    for name, make in writers_for(output_format, limits, highlight).items():
        # Formats order their lines by keys of different depth.
        lines = make(nested).withColumn("format", F.lit(name))
        out = lines if out is None else out.unionByName(lines)
    return out


def write_lines(lines: DataFrame, path: str, by: tuple[str, ...] = ("recording_id",)) -> None:
    """Write lines as text files under one folder per recording.

    Rows are spread by range over recording and order, so a recording larger than a task fills several files
    whose names sort in line order, and small recordings share tasks.
    """
    keys = [*by, "ord"]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*by, F.col("line").alias("value")).write.mode(
        "overwrite").partitionBy(*by).text(path)


def write_formats(
    nested: DataFrame, path: str, output_format: str = "all", limits: CueLimits = CueLimits(), highlight: bool = False,
) -> None:
    """Write the chosen formats to ``path/format=<name>/recording_id=<id>/`` in one job."""
    write_lines(fan_out(nested, output_format, limits, highlight), path, ("format", "recording_id"))
