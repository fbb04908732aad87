"""Forced alignment of characters to frames, from emission tables to timed sentences.

One segment is the unit of work: its frames are bounded by the length of a chunk. All roll-ups around the
path search are Spark expressions on the segment's row.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType

from speechloom.functions.fixed_values import LANGUAGES_WITHOUT_SPACES
from speechloom.functions.text import characters, spaceless
from speechloom.operators import paths, words as wd
from speechloom.plans.blocks import Scan, blocked_scan, checkpointed, index_block, shuffle_width

SEGMENT = ["recording_id", "segment_idx"]
WILDCARD = -1
PAD_NAMES = ("[pad]", "<pad>")


def char_tokens(text: Column, lang: Column, dictionary: dict[str, int]) -> Column:
    """``array<struct<cdx, token_id>>`` of the characters to align.

    Characters are looked up in lower case with ``|`` for a blank; unknown ones get the wildcard. Whitespace at
    both ends and blanks the dictionary lacks are left out.
    """
    lead = F.length(text) - F.length(F.regexp_replace(text, r"(?U)^\s+", ""))
    kept = F.length(F.regexp_replace(text, r"(?U)\s+$", ""))
    table = F.create_map(*[x for sign, number in dictionary.items() for x in (F.lit(sign), F.lit(number))])
    tight = spaceless(lang)

    def token(c: Column, i: Column, first: Column, behind: Column, no_bar: Column) -> Column:
        low = F.lower(c)
        sign = F.when((low == " ") & ~no_bar, "|").otherwise(low)
        number = F.element_at(table, sign)
        used = (i >= first) & (i < behind) & (number.isNotNull() | ~sign.isin(" ", "|"))
        return F.when(used, F.struct(i.cast("int").alias("cdx"), F.coalesce(number, F.lit(WILDCARD)).alias("token_id")))

    # The bounds are zipped in once per row instead of being worked out for every character.
    chars = characters(text)
    bounds = F.array_repeat(F.struct(lead.alias("first"), kept.alias("behind"), tight.alias("tight")), F.size(chars))
    numbered = F.transform(F.arrays_zip(chars.alias("c"), bounds.alias("b")), lambda z, i: token(
        z["c"], i, z["b"]["first"], z["b"]["behind"], z["b"]["tight"]))
    return F.filter(numbered, lambda t: t.isNotNull())


def blank_id(dictionary: DataFrame) -> DataFrame:
    """Blank class per language: 0 unless a padding entry exists; the last one in order wins."""
    pad = F.when(F.col("char").isin(*PAD_NAMES), F.col("ordinal"))
    return dictionary.groupBy("language").agg(F.coalesce(F.max_by("token_id", pad), F.lit(0)).alias("blank_id"))


def log_softmax(logits: Column) -> Column:
    """Log-probabilities of a frame; a frame with an unknown score has none."""
    return _normalised(logits.cast("array<double>"))


@F.arrow_udf(ArrayType(DoubleType()))
def _normalised(frames: pa.Array) -> pa.Array:
    """Many frames at a time, as functions called for every class of a frame are interpreted."""
    sizes = pc.fill_null(pc.list_value_length(frames), 0).to_numpy()
    flat = frames.flatten()
    x, full = flat.to_numpy(zero_copy_only=False), sizes[sizes > 0]
    if len(full):
        starts = np.cumsum(full) - full
        with np.errstate(invalid="ignore", divide="ignore"):
            x = x - np.repeat(np.maximum.reduceat(x, starts), full)
            x = x - np.repeat(np.log(np.add.reduceat(np.exp(x), starts)), full)
    gaps = None
    if flat.null_count:
        holes = np.add.reduceat(flat.is_null().to_numpy(zero_copy_only=False).astype(np.int64), starts) > 0
        gaps = pa.array(np.repeat(holes, full))
    values = pa.array(x, pa.float64(), mask=None if gaps is None else gaps.to_numpy(zero_copy_only=False))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=frames.is_null())


def wildcard_score(logp: Column, blank: int = 0) -> Column:
    """Best class of a frame other than the blank."""
    return F.array_max(F.concat(F.slice(logp, 1, blank), F.slice(logp, blank + 2, F.greatest(F.size(logp), F.lit(0)))))


def spread(segments: DataFrame) -> DataFrame:
    """Segments over all shuffle partitions: the next stage costs compute, while adaptive coalescing counts bytes."""
    return segments.repartition(shuffle_width(segments), *SEGMENT)


Model = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
EMISSION_FIELDS = "n_frames int, n_classes int, logits array<float>"
MODEL_KINDS = ("tuple", "logits")


def emit_with(segments: DataFrame, model: Model, kind: str = "logits") -> DataFrame:
    """Run an acoustic model over segment rows in Arrow batches.

    It yields the rows with ``n_frames, n_classes, logits`` (frame after frame) and gets them in pieces of about
    ``MODEL_CHARS`` characters, so that emissions of many rows are never held at once. ``kind`` names the calling
    convention of the wrapped model; any other is an error.
    """
    if kind not in MODEL_KINDS:
        raise NotImplementedError(f"alignment model of kind {kind} is not supported")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from model(piece for batch in batches for piece in _by_size(batch))

    return spread(segments).mapInPandas(run, f"{columns}, {EMISSION_FIELDS}")


def best_path(logp: np.ndarray, tokens: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Token index, frame and probability along the best monotone path of one segment; None if there is none."""
    path = paths.best_paths([paths.Segment(logp, tokens, blank)])[0]
    return None if path is None else (path.token, path.frame, path.prob)


def _scored(logits: np.ndarray, frames: int, classes: int, ids, blank: int, log_probs: bool) -> paths.Segment:
    """One segment for the search: normalised scores with the wildcard's class, the best but the blank, behind the last."""
    tokens = np.asarray(ids, dtype=np.int64)
    logp = np.asarray(logits, dtype=np.float32).reshape(frames, classes)
    if not log_probs and frames:
        top = logp.max(axis=1, keepdims=True)
        logp = logp - (top + np.log(np.exp(logp - top).sum(axis=1, keepdims=True)))
    if (tokens == WILDCARD).any():
        other = np.delete(logp, blank, axis=1).max(axis=1, keepdims=True)
        logp = np.concatenate((logp, other), axis=1)
        tokens = np.where(tokens == WILDCARD, classes, tokens)
    return paths.Segment(logp, tokens, blank)


def _paths(batch: pd.DataFrame, blank: int, log_probs: bool) -> list[paths.Path | None]:
    """Paths of all rows of a batch with ``token_ids, n_frames, n_classes, logits``."""
    return paths.best_paths([
        _scored(logits, frames, classes, ids, blank, log_probs) for logits, frames, classes, ids in zip(
            batch["logits"], batch["n_frames"], batch["n_classes"], batch["token_ids"], strict=True)])


PATH_SCHEMA = "recording_id {id}, segment_idx bigint, token_idx int, time_idx int, score double"


def align_paths(segments: DataFrame, blank: int = 0, log_probs: bool = False, model: Model | None = None) -> DataFrame:
    """Path points of segments with ``token_ids, n_frames, n_classes, logits``; a failed one gives one row of nulls.

    ``log_probs``: the emissions are normalised already. With a ``model`` the segments come without emissions: model and
    search are one pass of a task over its rows, in pieces as ``emit_with`` makes them, and emissions never leave it.
    """

    def run(batches):
        for batch in batches if model is None else model(piece for rows in batches for piece in _by_size(rows)):
            found = _paths(batch, blank, log_probs)
            sizes = np.array([1 if p is None else len(p.token) for p in found], dtype=np.int64)
            if not len(sizes):
                continue
            void = np.repeat([p is None for p in found], sizes)
            joined = lambda part: np.concatenate([[0] if p is None else part(p) for p in found])
            yield pd.DataFrame({
                "recording_id": np.repeat(batch["recording_id"].to_numpy(), sizes),
                "segment_idx": np.repeat(batch["segment_idx"].to_numpy(), sizes),
                "token_idx": pd.array(joined(lambda p: p.token), dtype="Int32"), "time_idx": pd.array(joined(lambda p: p.frame), dtype="Int32"),
                "score": pd.array(joined(lambda p: p.prob), dtype="Float64")}).assign(
                **{c: lambda d, c=c: d[c].mask(void) for c in ("token_idx", "time_idx", "score")})

    schema = PATH_SCHEMA.format(id=segments.schema["recording_id"].dataType.simpleString())
    if model is not None:
        return spread(segments).mapInPandas(run, schema)
    return segments.select(*SEGMENT, "token_ids", "n_frames", "n_classes", "logits").mapInPandas(run, schema)


def merge_repeats(path: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Runs of a token: frames ``[f_start, f_end)`` and mean score. The token index never steps back along a path.

    ``carried`` names columns of the path that have one value per segment and stay on its runs.
    """
    return path.filter(F.col("token_idx").isNotNull()).groupBy(*SEGMENT, "token_idx").agg(
        F.min("time_idx").alias("f_start"), (F.max("time_idx") + 1).alias("f_end"), F.avg("score").alias("score"),
        *[F.max(c).alias(c) for c in carried])


def frame_to_ms(frame: Column, start_ms: Column, end_ms: Column, n_frames: Column) -> Column:
    """Time of a frame border within its segment."""
    return F.rint(frame * ((end_ms - start_ms) / n_frames) + start_ms).cast("bigint")


def fail_reason(segments: DataFrame) -> DataFrame:
    """Why a segment cannot be aligned before trying: nothing to align, or it starts behind the audio.

    Needs ``token_ids``, ``start_ms`` and ``audio_ms``.
    """
    return segments.withColumn(
        "fail_reason", F.when(F.size("token_ids") == 0, "no_characters").when(
            F.col("start_ms") >= F.col("audio_ms"), "beyond_audio"))


def with_tokens(segments: DataFrame, dictionary: dict[str, int]) -> DataFrame:
    """Adds ``token_ids`` and ``token_cdx``, the characters to align and where they stand in the text."""
    tokens = segments.withColumn("_t", char_tokens(F.col("text"), F.col("lang"), dictionary))
    return tokens.withColumns({
        "token_ids": F.transform("_t", lambda t: t["token_id"]), "token_cdx": F.transform("_t", lambda t: t["cdx"]),
    }).drop("_t")


@dataclass(frozen=True)
class Voice:
    """What a language is aligned with: an acoustic model, its characters' classes, and whether it emits log-probabilities."""

    model: Model
    dictionary: Mapping[str, int]
    log_probs: bool = False

    @property
    def blank(self) -> int:
        """Class of the padding entry, of several the last, else 0."""
        return next((n for s, n in reversed(list(self.dictionary.items())) if s in PAD_NAMES), 0)


_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class CharTable:
    """Classes of characters as ``char_tokens`` finds them, worked out once for each character met."""

    def __init__(self, dictionary: Mapping[str, int], tight: bool):
        self.dictionary, self.tight, self.known = dictionary, tight, {}

    def _class(self, char: str) -> int | None:
        low = char.lower()
        sign = "|" if low == " " and not self.tight else low
        number = self.dictionary.get(sign)
        return None if number is None and sign in (" ", "|") else WILDCARD if number is None else number

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Classes of the characters to align, and their places in the text."""
        known = self.known
        for char in set(text) - known.keys():
            known[char] = self._class(char)
        lead, behind = len(text) - len(text.lstrip(_WHITE)), len(text.rstrip(_WHITE))
        found = [(known[text[i]], i) for i in range(lead, behind)]
        found = [x for x in found if x[0] is not None]
        return [n for n, _ in found], [i for _, i in found]


#: Characters of the texts that a model gets at a time; emissions are some hundred times larger.
MODEL_CHARS = 1 << 16
_TIMES = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("score", pa.float64())]))


def _judged(rows: pd.DataFrame, voice: Voice | None, table: CharTable | None) -> pd.DataFrame:
    """Rows with their tokens and the reason why they cannot be tried, if any."""
    if voice is None:
        return rows.assign(token_ids=[[] for _ in range(len(rows))], token_cdx=[[] for _ in range(len(rows))], fail_reason="no_model")
    tokens = [table.tokens(t or "") for t in rows["text"]]
    late = (rows["start_ms"] >= rows["audio_ms"]).fillna(False).to_numpy(dtype=bool)
    none = np.array([not ids for ids, _ in tokens], dtype=bool)
    unset = rows[["start_ms", "end_ms"]].isna().any(axis=1).to_numpy(dtype=bool)
    return rows.assign(token_ids=[x[0] for x in tokens], token_cdx=[x[1] for x in tokens], fail_reason=np.select(
        [none, unset, late], ["no_characters", "no_times", "beyond_audio"], None))


def _by_size(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows in pieces of about ``MODEL_CHARS`` characters (tokens, where rows have no text)."""
    sizes = rows["text" if "text" in rows else "token_ids"].str.len().fillna(0).astype("int64") + 1
    for _, part in rows.groupby((sizes.cumsum() // MODEL_CHARS).to_numpy(), sort=False):
        yield part.reset_index(drop=True)


def _timed(rows: pd.DataFrame, voice: Voice) -> tuple[list[int], np.ndarray, np.ndarray]:
    """For each row the number of characters, or -1 without a path; start, end and score of all characters end to end, and which are known."""
    values, known, sizes = [], [], []
    facts = zip(_paths(rows, voice.blank, voice.log_probs), rows["text"], rows["token_cdx"], rows["start_ms"], rows["end_ms"], rows["n_frames"], strict=True)
    for path, text, places, start, end, frames in facts:
        if path is None:
            sizes.append(-1)
            continue
        opens = np.flatnonzero(np.diff(path.token, prepend=-1))
        size = np.diff(np.append(opens, len(path.token)))
        at = np.asarray(places)[path.token[opens]]
        scale = (end - start) / frames
        cell = np.zeros((3, len(text)))
        cell[0, at] = np.rint(path.frame[opens] * scale + start)
        cell[1, at] = np.rint((path.frame[opens + size - 1] + 1) * scale + start)
        cell[2, at] = np.rint(np.add.reduceat(path.prob, opens) / size * 1000.0) / 1000.0
        on = np.zeros(len(text), dtype=bool)
        on[at] = True
        values.append(cell)
        known.append(on)
        sizes.append(len(text))
    return sizes, np.concatenate(values or [np.zeros((3, 0))], axis=1), np.concatenate(known or [np.zeros(0, dtype=bool)])


def _times(sizes: list[int], values: np.ndarray, known: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    fields = [pa.array(values[0].astype(np.int64), mask=~known), pa.array(values[1].astype(np.int64), mask=~known), pa.array(values[2], mask=~known)]
    gone = pa.array([s < 0 for s in sizes])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_TIMES.value_type)), mask=gone)


def tried_segments(segments: DataFrame, voices: Mapping[str | None, Voice]) -> DataFrame:
    """The segments with ``times``, an entry per character (null fields where it has no time), or a ``fail_reason``.

    ``segments``: ``recording_id, segment_idx, lang, text, start_ms, end_ms, audio_ms`` and any others. ``voices`` by language; the one
    named None serves all languages without their own, and without it such segments fail with ``no_model``.
    Characters, model, path search and times are one pass of a task over its rows. With several languages rows are dealt in
    ranges of (language, hash): a task has few languages, a frequent one is spread, and a model sees its rows as one stream.
    """
    several = len(voices) > 1 or None not in voices
    if several:
        dealt = segments.withColumn("_deal", F.xxhash64(*SEGMENT))
        dealt = dealt.repartitionByRange(shuffle_width(segments), "lang", "_deal").sortWithinPartitions("lang").drop("_deal")
    else:
        dealt = spread(segments)
    arrow = to_arrow_schema(segments.schema)
    names = [f.name for f in arrow]

    def voiced(lang: str | None) -> Voice | None:
        return voices.get(lang, voices.get(None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aside: list[pd.DataFrame] = []

        def packed(rows: pd.DataFrame, reasons, times: pa.Array) -> pa.RecordBatch:
            passed = [pa.Array.from_pandas(rows[f.name], type=f.type) for f in arrow]
            return pa.RecordBatch.from_arrays([*passed, pa.array(reasons, pa.string()), times], names=[*names, "fail_reason", "times"])

        def put_aside() -> Iterator[pa.RecordBatch]:
            while aside:
                rows = aside.pop()
                yield packed(rows, rows["fail_reason"].tolist(), pa.array([None] * len(rows), _TIMES))

        def stream(parts: Iterator[pd.DataFrame], voice: Voice | None, table: CharTable | None) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = _judged(part, voice, table)
                bad = rows["fail_reason"].notna()
                if bad.any():
                    aside.append(rows[bad])
                if not bad.all():
                    yield from _by_size(rows[~bad])

        def parts() -> Iterator[tuple[str | None, pd.DataFrame]]:
            for batch in batches:
                rows = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
                for lang, part in rows.groupby(rows["lang"].astype(object).where(rows["lang"].notna(), ""), sort=False):
                    yield lang or None, part.reset_index(drop=True)

        for lang, group in itertools.groupby(parts(), key=lambda x: x[0]):
            voice = voiced(lang)
            table = None if voice is None else CharTable(voice.dictionary, lang in LANGUAGES_WITHOUT_SPACES)
            ready = stream((rows for _, rows in group), voice, table)
            for rows in ready if voice is None else voice.model(ready):
                sizes, values, known = _timed(rows, voice)
                yield packed(rows, ["no_path" if s < 0 else None for s in sizes], _times(sizes, values, known))
                yield from put_aside()
            yield from put_aside()

    passed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema.fields)
    return dealt.mapInArrow(run, f"{passed}, fail_reason string, times array<struct<start_ms:bigint,end_ms:bigint,score:double>>")


def align_corpus(segments: DataFrame, model: Model | Mapping[str | None, Voice], dictionary: dict[str, int] | None = None,
                 method: str = "nearest", chars: bool = False) -> tuple[DataFrame, DataFrame]:
    """Aligned sentences and words of a corpus.

    ``segments``: ``recording_id, segment_idx, lang, text, start_ms, end_ms, audio_ms``, and ``avg_logprob`` where it is to be carried. ``model`` is a
    model for all languages with its ``dictionary``, or a ``Voice`` per language. Returns ``(sentences, words)``; segments
    that cannot be aligned are sentences without words that carry a ``fail_reason``. ``chars`` adds the timed characters of each
    sentence. Up to the sentences everything stays on the row of its segment; one shuffle by segment then serves all
    interpolation and merging.
    """
    voices = {None: Voice(model, dictionary)} if dictionary is not None else dict(model)
    carried = [c for c in ("avg_logprob",) if c in segments.columns]
    # Model and path search are the costly part and have several readers: written once, they survive lost executors.
    tried = checkpointed(tried_segments(segments, voices).select(
        *SEGMENT, "lang", "text", "start_ms", "end_ms", *carried, "fail_reason", "times"))
    given_up = tried.filter(F.col("fail_reason").isNotNull()).select(*SEGMENT, "text", "start_ms", "end_ms", *carried, "fail_reason")
    done = tried.filter(F.col("fail_reason").isNull()).select(*SEGMENT, "lang", "text", *carried, "times")
    by_sentence = wd.timed_sentences(done)
    words = wd.interpolate_words(
        wd.word_rollup(by_sentence).repartition(*SEGMENT), [*SEGMENT, "sentence_idx"], method=method)
    sentences = wd.sentence_rollup(by_sentence).select(
        *SEGMENT, "lang", "sentence_idx", "text", "start_ms", "end_ms", *carried, *(["chars"] if chars else []))
    # Sentence times are filled in either mode that fills; without filling, unknown ones drop out in the merge.
    filled = wd.interpolate_sentences(sentences.repartition(*SEGMENT), method)
    merged = wd.merge_equal_sentences(filled, F.col("lang"))
    parts = merged.select(*SEGMENT, F.col("first_idx").cast("bigint").alias("part"),
                          F.explode("members").alias("sentence_idx"))
    return wd.with_fallbacks(merged, given_up), words.join(parts, [*SEGMENT, "sentence_idx"])


def aligned_segments(sentences: DataFrame, words: DataFrame, lang: Column | None = None) -> DataFrame:
    """The result of ``align_corpus`` as nested segments for cues and writers, one per sentence.

    Segments are numbered anew in order; those passed through have no words. ``speaker`` columns of either table,
    as added by speaker assignment, are kept.
    """
    named = "speaker" in words.columns
    fields = ["word", "start_ms", "end_ms", "score", *(["speaker"] if named else [])]
    lists = words.groupBy(*SEGMENT, "part").agg(
        F.sort_array(F.collect_list(F.struct("sentence_idx", "word_idx", *fields))).alias("_w"))
    joined = sentences.join(lists, [*SEGMENT, "part"], "left")
    extra = [c for c in ("avg_logprob", "chars") if c in sentences.columns]
    speaker = F.col("speaker") if "speaker" in sentences.columns else F.lit(None).cast("string")
    numbered = blocked_scan(
        joined.select(*SEGMENT, "part", speaker.alias("speaker"), "text", "start_ms", "end_ms", *extra, "_w"), ["recording_id"],
        index_block("segment_idx", 4096), ["segment_idx", "part"], [Scan("_n", "sum", F.lit(1))])
    kept = F.transform("_w", lambda w: F.struct(*[w[f].alias(f) for f in fields]))
    return numbered.select(
        "recording_id", (F.col("_n") - 1).cast("bigint").alias("segment_idx"), "speaker",
        (F.lit(None).cast("string") if lang is None else lang).alias("lang"), "text", "start_ms", "end_ms",
        F.coalesce(kept, F.array().cast(_word_type(named))).alias("words"), *extra)


def _word_type(named: bool) -> str:
    speaker = ",speaker:string" if named else ""
    return f"array<struct<word:string,start_ms:bigint,end_ms:bigint,score:double{speaker}>>"
