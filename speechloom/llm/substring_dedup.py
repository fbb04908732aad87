"""Removal of long substrings that occur in an earlier document, by suffix arrays over shards.

Every window of ``LENGTH`` bytes has an anchor: the ``GRAM`` bytes in it with the smallest hash, the leftmost of equals. Equal
windows have equal anchors, so work can be dealt by anchor and no match is lost. Texts that are equal as a whole are
one text throughout.

1. Anchors of all texts are shuffled in compact blocks to find those that at least two texts share.
2. Texts with shared anchors are cut into segments, the stretches of windows with one anchor. Equal segments of a
   task are sent once, with the smallest document; the others are decided on the spot.
3. A shard holds the segments of a range of anchors, about ``SHARD_BYTES`` of them. Its suffix array (induced sorting) and
   permuted common prefixes put equal windows side by side; the smallest document of each group decides.
4. What is removed travels back to the texts as ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from speechloom.llm.batches import distinct_slices, flat, in_rows, mixed, ragged, sliced, spread
from speechloom.llm.grouped import with_group_values
from speechloom.llm.names import clashes, named, with_new_names
from speechloom.llm.suffix_arrays import permuted_lcp, suffix_array
from speechloom.plans.blocks import checkpointed, inner_tables, let_shuffles_go

LENGTH = 50
GRAM = 16
FLUSH = 1 << 19
SLICE = 1 << 18
SEEN = 1 << 20
SEGMENT_FLUSH = 8 << 20
SHARD_BYTES = 3 << 18


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at each position that has so many; equal for equal bytes in every batch.

    It deals work only: grams that differ may share one.
    """
    n = len(data) - GRAM + 1
    words = np.ndarray(n + 8, "<u8", np.ascontiguousarray(data), strides=(1,))
    return mixed(words[:n] * np.uint64(0x9E3779B97F4A7C15) + words[8:] * np.uint64(0xD6E8FEB86659FD93))


def segments_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of every segment, its 48-bit anchor, and its text."""
    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if len(data) < LENGTH:
        return none
    hashes = gram_hashes(data)
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width, reach = LENGTH - GRAM + 1, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach:])
    # Windows that begin less than their length in front of a text's end are no windows, so texts are apart.
    inside = np.ones(len(low), bool)
    cross = (offsets[1:-1, None] - np.arange(1, LENGTH)).ravel()
    inside[cross[(cross >= 0) & (cross < len(low))]] = False
    new, end = inside.copy(), inside.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    end[:-1] &= new[1:] | ~inside[1:]
    first = np.flatnonzero(new)
    # Anchors have small hashes by their choice; another mixing makes their names even, so that they can deal the work.
    gram = mixed(hashes[(low[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)] ^ np.uint64(1)) >> np.uint64(16)
    return first, np.flatnonzero(end), gram, np.searchsorted(offsets, first, "right") - 1


def text_digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw, cut = memoryview(data.tobytes()), offsets.tolist()
    return [hashlib.sha256(raw[a:b]).digest() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def text_names(data: np.ndarray, offsets: np.ndarray, renames: dict) -> np.ndarray:
    """The name of each text, from its SHA-256."""
    return named(b"".join(d[:16] for d in text_digests(data, offsets)), renames)[0]


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, name, name2, sha256`` of every text."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text", SLICE):
            data, offsets = flat(batch.column("_text"))
            digests = text_digests(data, offsets)
            name, second = named(b"".join(d[:16] for d in digests))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(name), pa.array(second), pa.array([d.hex() for d in digests], pa.string())],
                names=["doc_id", "n_bytes", "name", "name2", "sha256"])

    return docs.mapInArrow(describe, "doc_id bigint, n_bytes bigint, name bigint, name2 bigint, sha256 string")


def packed_rows(gram: np.ndarray, name: np.ndarray) -> bytes:
    """Rows (48-bit gram, name) in a block: its names once, then for each row six bytes and the place of its name."""
    names, at = np.unique(name, return_inverse=True)
    kind = "<u2" if len(names) <= 1 << 16 else "<u4"
    six = gram.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return np.array([len(gram), len(names)], "<i8").tobytes() + names.astype("<i8").tobytes() + six.tobytes() + at.astype(kind).tobytes()


def unpacked_rows(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, k = np.frombuffer(block, "<i8", 2).tolist()
    names = np.frombuffer(block, "<i8", k, 16)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(block, np.uint8, 6 * n, 16 + 8 * k).reshape(n, 6)
    at = np.frombuffer(block, "<u2" if k <= 1 << 16 else "<u4", n, 16 + 8 * k + 6 * n)
    return wide.view("<u8").ravel(), names[at]


def _by_name(gram: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    """One row of grams for each name."""
    order = np.argsort(name, kind="stable")
    gram, name = gram[order], name[order]
    first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
    cut = [*first.tolist(), len(name)]
    cells = [gram[a:b].astype("<u8").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(name[first]), pa.array(cells, pa.binary())], names=["name", "grams"])


def anchor_blocks(docs: DataFrame, buckets: int, renames: dict) -> DataFrame:
    """``bucket, block``: packed (anchor, text name) rows; a negative bucket of its own holds each block of those found shared
    within a task, which need no further grouping."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, turn = 0, TaskContext.get().partitionId() << 24

        def flushed() -> pa.RecordBatch:
            nonlocal held, size, turn
            gram, name = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size, turn = [], 0, turn + 1
            order = np.lexsort((name, gram))
            gram, name = gram[order], name[order]
            new = np.append(True, (gram[1:] != gram[:-1]) | (name[1:] != name[:-1]))
            gram, name = gram[new], name[new]
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            run = np.diff(np.append(first, len(gram)))
            shared = np.repeat(run > 1, run)
            keys, blocks = [], []
            if shared.any():
                keys.append(-turn)
                blocks.append(packed_rows(gram[shared], name[shared]))
            gram, name = gram[first], name[first]
            bucket = ((gram >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(gram)], strict=True):
                keys.append(int(bucket[a]))
                blocks.append(packed_rows(gram[a:b], name[a:b]))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

        for batch in sliced(batches, "_text", SLICE):
            data, offsets = flat(batch.column("_text"))
            names = text_names(data, offsets, renames)
            fresh = np.array([not (x in seen or seen.add(x)) for x in names.tolist()], bool)
            if len(seen) > SEEN:
                seen.clear()
            _, _, gram, text = segments_of(data, offsets)
            on = fresh[text]
            if on.any():
                held.append((gram[on], names[text[on]]))
                size += int(on.sum())
            if size >= FLUSH:
                yield flushed()
        if size:
            yield flushed()

    return docs.mapInArrow(emit, "bucket bigint, block binary")


def shared_anchors(blocks: DataFrame, homes: int) -> DataFrame:
    """``name, grams``: for each text the anchors that it shares with another.

    What a bucket finds goes back in blocks by ``home``, a range of names, so that rows stay as few as blocks.
    """

    def find(table: pa.Table) -> pa.Table:
        cells = table.column("block").to_pylist()
        gram, name = (np.concatenate(x) for x in zip(*map(unpacked_rows, cells), strict=True))
        if table.column("bucket")[0].as_py() >= 0:
            order = np.lexsort((name, gram))
            gram, name = gram[order], name[order]
            new = np.append(True, (gram[1:] != gram[:-1]) | (name[1:] != name[:-1]))
            gram, name = gram[new], name[new]
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            run = np.diff(np.append(first, len(gram)))
            on = np.repeat(run > 1, run)
            gram, name = gram[on], name[on]
        home = ((mixed(name.view(np.uint64)) >> np.uint64(32)) * np.uint64(homes)) >> np.uint64(32)
        order = np.argsort(home, kind="stable")
        gram, name, home = gram[order], name[order], home[order]
        cut = np.flatnonzero(np.append(True, home[1:] != home[:-1])).tolist() if len(home) else []
        ends = [*cut[1:], len(home)] if cut else []
        return pa.table({"home": pa.array([int(home[a]) for a in cut], pa.int64()),
                         "block": pa.array([packed_rows(gram[a:b], name[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        gram, name = (np.concatenate(x) for x in zip(*map(unpacked_rows, table.column("block").to_pylist()), strict=True))
        return pa.Table.from_batches([_by_name(gram, name)])

    found = blocks.groupBy("bucket").applyInArrow(find, "home bigint, block binary")
    return found.groupBy("home").applyInArrow(gather, "name bigint, grams binary")


def packed_texts(docs: DataFrame, renames: dict) -> DataFrame:
    """``doc_id, name, packed``: compressed texts."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in sliced(batches, "_text", SLICE):
            data, offsets = flat(batch.column("_text"))
            raw, cut = data.tobytes(), offsets.tolist()
            cells = [pack(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(text_names(data, offsets, renames)), pa.array(cells, pa.binary())],
                names=["doc_id", "name", "packed"])

    return docs.mapInArrow(squeeze, "doc_id bigint, name bigint, packed binary")


def segment_blocks(texts: DataFrame, shards: int) -> DataFrame:
    """``shard, block``: packed segments; a negative shard of its own holds each block of ranges that are decided already, as
    (name, start, end)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        held: list[tuple] = []
        size, turn = 0, TaskContext.get().partitionId() << 24

        def flushed() -> pa.RecordBatch:
            nonlocal held, size, turn
            gram, doc, name, start, length = (np.concatenate([h[i] for h in held]) for i in range(5))
            body = np.concatenate([h[5] for h in held])
            held, size, turn = [], 0, turn + 1
            begin = np.cumsum(length) - length
            content, _ = distinct_slices(body, begin)
            order = np.lexsort((doc, content))
            first = np.flatnonzero(np.append(True, content[order][1:] != content[order][:-1]))
            run = np.diff(np.append(first, len(order)))
            least = np.empty(len(order), np.int64)
            least[order] = np.repeat(doc[order][first], run)
            later = doc > least
            keys, blocks = [], []
            if later.any():
                keys.append(-turn)
                blocks.append(np.concatenate([name[later], start[later], (start + length)[later]]).astype("<i8").tobytes())
            todo = np.flatnonzero(~later)
            shard = ((gram[todo] >> np.uint64(16)) * np.uint64(shards)) >> np.uint64(32)
            order = np.argsort(shard, kind="stable")
            todo, shard = todo[order], shard[order]
            cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(todo) else np.zeros(0, np.int64)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(todo)], strict=False):
                at = todo[a:b]
                keys.append(int(shard[a]))
                blocks.append(b"".join([
                    np.array([len(at)], "<i8").tobytes(), doc[at].astype("<i8").tobytes(), name[at].astype("<i8").tobytes(),
                    start[at].astype("<u4").tobytes(), length[at].astype("u1").tobytes(), squeeze(body[spread(begin[at], length[at])].tobytes())]))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.binary())], names=["shard", "block"])

        for batch in in_rows(batches):
            raw = pa.array([expand(x) for x in batch.column("packed").to_pylist()], pa.binary())
            whole = pa.record_batch({"t": raw, "doc": batch.column("doc_id"), "name": batch.column("name"), "grams": batch.column("grams")})
            for part in sliced([whole], "t", SLICE):
                data, offsets = flat(part.column("t"))
                first, last, gram, text = segments_of(data, offsets)
                # A slice has far fewer than 2^16 texts, so a text and its 48-bit anchor are one number.
                asked, cut = flat(part.column("grams"))
                asked = np.sort(asked.copy().view("<u8") | (ragged(np.diff(cut) // 8)[0] << 48).view(np.uint64))
                wanted = gram | (text << 48).view(np.uint64)
                on = np.zeros(len(text), bool) if not len(asked) else asked[np.minimum(np.searchsorted(asked, wanted), len(asked) - 1)] == wanted
                first, last, gram, text = first[on], last[on], gram[on], text[on]
                if not len(first):
                    continue
                end = last + LENGTH
                held.append((gram, part.column("doc").to_numpy()[text], part.column("name").to_numpy()[text],
                             first - offsets[text], end - first, data[spread(first, end - first)]))
                size += len(held[-1][5])
                if size >= SEGMENT_FLUSH:
                    yield flushed()
        if size:
            yield flushed()

    return texts.mapInArrow(emit, "shard bigint, block binary")


def _ranges(table: pa.Table) -> pa.Table:
    """Removed byte ranges (``name, start, stop``) that a shard's segments prove."""
    blocks = table.column("block").to_pylist()
    if not blocks or table.column("shard")[0].as_py() < 0:
        cells = [np.frombuffer(b, "<i8").reshape(3, -1) for b in blocks]
        name, start, stop = (np.concatenate([c[i] for c in cells]) if cells else np.zeros(0, np.int64) for i in range(3))
        return pa.table({"name": name, "start": start, "stop": stop})
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    docs, names, starts, lengths, bodies = [], [], [], [], []
    for block in blocks:
        n = int(np.frombuffer(block, "<i8", 1)[0])
        docs.append(np.frombuffer(block, "<i8", n, 8))
        names.append(np.frombuffer(block, "<i8", n, 8 + 8 * n))
        starts.append(np.frombuffer(block, "<u4", n, 8 + 16 * n).astype(np.int64))
        lengths.append(np.frombuffer(block, "u1", n, 8 + 20 * n).astype(np.int64))
        bodies.append(np.frombuffer(expand(block[8 + 21 * n:]), np.uint8))
    doc, name, start, length = (np.concatenate(x) for x in (docs, names, starts, lengths))
    body = np.concatenate(bodies)
    begin = np.cumsum(length) - length
    # Each content stands once, with the smallest document that has it.
    content, _ = distinct_slices(body, begin)
    order = np.lexsort((doc, content))
    head = np.append(True, content[order][1:] != content[order][:-1])
    first = order[head]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(head) - 1
    # Segments end with a mark that no text holds; the last character of all is the only smallest.
    size = length[first]
    rows, off = ragged(size + 1)
    at = begin[first][rows] + np.minimum(off, size[rows] - 1)
    ends = off == size[rows]
    data = np.where(ends, np.uint8(0xFF), body[at])
    text = np.append(np.where(ends, 1, data.astype(np.int16) + 2), 0).astype(np.int16)
    order = suffix_array(text, LENGTH)
    window = np.zeros(len(text), bool)
    window[:-1] = off + LENGTH <= size[rows]
    order = order[window[order]]
    data = np.append(data, np.zeros(LENGTH + 8, np.uint8))
    same = permuted_lcp(data, order, LENGTH)[order] >= LENGTH
    groups = np.flatnonzero(~same)
    of_window = doc[first][rows[order]]
    least = np.full(len(text), np.iinfo(np.int64).max)
    least[order] = np.repeat(np.minimum.reduceat(of_window, groups), np.diff(np.append(groups, len(order))))
    # Windows of every occurrence, against its own document.
    base = np.cumsum(size + 1) - (size + 1)
    many = length - LENGTH + 1
    occurrence, nth = ragged(many)
    gone = least[base[kind[occurrence]] + nth] < doc[occurrence]
    occurrence, nth = occurrence[gone], nth[gone]
    if not len(nth):
        return pa.table({"name": name[:0], "start": start[:0], "stop": start[:0]})
    new = np.append(True, (occurrence[1:] != occurrence[:-1]) | (nth[1:] != nth[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(nth)) - 1
    owner = occurrence[first]
    return pa.table({"name": name[owner], "start": start[owner] + nth[first], "stop": start[owner] + nth[last] + LENGTH})


def joined_ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the ranges."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.append(True, starts[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


def _reps(info: DataFrame) -> DataFrame:
    """A row per name: the smallest document, the text's size, how many rows have it, and the bounds of second names."""
    return checkpointed(info.where(f"n_bytes >= {LENGTH} and doc_id is not null").groupBy("name").agg(
        F.min("doc_id").alias("rep"), F.first("n_bytes").alias("size"), F.count("*").alias("_rows"),
        F.min("name2").alias("low2"), F.max("name2").alias("high2")))


def _cuts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is known of every row (``described`` with ``rep``, the smallest document of equal text), and for each text with
    removed ranges ``name, packed, ranges``. ``docs`` has ``doc_id, _text``."""
    info = checkpointed(described(docs))
    docs = docs.where("doc_id is not null")
    reps = _reps(info)
    if renames := clashes(reps, info.where(f"n_bytes >= {LENGTH}")):
        info = with_new_names(info, renames)
        reps = _reps(info)
    total = int(reps.agg(F.sum("size")).first()[0] or 0)
    buckets = max(1, total // (18 * FLUSH))
    shared = checkpointed(shared_anchors(anchor_blocks(docs, buckets, renames), buckets))
    let_shuffles_go(docs.sparkSession)
    grams = shared.agg(F.sum(F.octet_length("grams"))).first()[0] or 0
    shards = max(1, int(grams) // 8 * 68 // SHARD_BYTES)
    asked = shared.join(reps, "name").select(
        F.col("rep").alias("doc_id"), "name", "grams")
    texts = checkpointed(packed_texts(docs, renames).join(asked, ["doc_id", "name"]).dropDuplicates(["doc_id", "name"]))
    let_shuffles_go(docs.sparkSession)
    # A table of its own, so that the segments are gone before the texts are shuffled.
    ranges = checkpointed(segment_blocks(texts, shards).groupBy("shard").applyInArrow(_ranges, "name bigint, start bigint, stop bigint"))
    ranges = ranges.groupBy("name").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    cut = texts.select("name", "packed").join(ranges, "name")
    # Names with many copies are few and broadcast.
    many = checkpointed(reps.where("_rows > 1").select("name", "rep", "_rows"))
    facts = with_group_values(info, many, ["name"], "_rows", how="left")
    return checkpointed(facts.select("doc_id", "n_bytes", "name", "sha256", F.coalesce("rep", "doc_id").alias("rep"))), cut


def _joined(info: DataFrame, results: DataFrame) -> DataFrame:
    """All rows with the result of their text; copies of an earlier document go whole and ask for none."""
    copy = F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False))
    alone = info.where(~copy).join(results, "name", "left")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in results.schema if f.name != "name"]
    return alone.select(*info.columns, *[c for c in results.columns if c != "name"]).union(info.where(copy).select(*info.columns, *nothing))


def _kept(raw: bytes, ranges: list[dict]) -> tuple[bytes, int, int, str]:
    """The bytes that stay, how many go and in how many runs, and the text with whole characters only."""
    bounds = np.array([(r["start"], r["stop"]) for r in ranges], np.int64)
    starts, stops = joined_ranges(bounds[:, 0], bounds[:, 1])
    marks = [0, *np.stack([starts, stops], axis=1).ravel().tolist(), len(raw)]
    kept = b"".join(raw[a:b] for a, b in zip(marks[::2], marks[1::2], strict=True))
    # A character that is only partly covered stays in the text.
    inner = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    text, at = [], 0
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        while inner(a):
            a += 1
        while inner(b):
            b -= 1
        if a < b:
            text.append(raw[at:a])
            at = b
    text.append(raw[at:])
    return kept, int((stops - starts).sum()), len(starts), b"".join(text).decode()


def _results(cut: DataFrame, texts: bool) -> DataFrame:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in in_rows(batches):
            rows = [_kept(expand(p), r) for p, r in zip(batch.column("packed").to_pylist(), batch.column("ranges").to_pylist(), strict=True)]
            columns = [batch.column("name"), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                       pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())]
            if texts:
                columns.append(pa.array([r[3] for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["name", "gone", "runs", "digest", "left"][: len(columns)])

    return cut.mapInArrow(finish, "name bigint, gone bigint, runs bigint, digest string" + (", left string" if texts else ""))


_EMPTY = hashlib.sha256(b"").hexdigest()


def substring_cuts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    A byte goes when a string of ``LENGTH`` bytes over it also starts in a document with a smaller id. Null and empty texts
    and texts shorter than that lose nothing. A row with a null id is neither earlier nor later than any and loses nothing.
    Rows with equal id and text are one document, so they keep what that keeps. Other columns are not read; an
    empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("_text"))
    with inner_tables(docs.sparkSession) as kept:
        info, cut = _cuts(narrow)
        copy = F.col("doc_id") > F.col("rep")
        return kept(_joined(info, _results(cut, texts=False)).select(
            "doc_id", "n_bytes",
            F.when(F.col("doc_id").isNull(), 0).when(copy, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("bigint").alias("n_removed"),
            F.when(F.col("doc_id").isNull(), 0).when(copy, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("bigint").alias("n_spans"),
            F.when(F.col("doc_id").isNull(), F.col("sha256")).when(copy, _EMPTY).otherwise(F.coalesce("digest", "sha256")).alias("kept_sha256")))


def cut_texts(docs: DataFrame) -> DataFrame:
    """The documents with repeated substrings removed from ``text``; ``n_chars``, where there is one, counts what is left.

    A character of which only some bytes repeat stays. All rows and columns stay, with empty texts where everything repeats; null
    texts stay null and rows with a null id as they are.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("_text"))
    with inner_tables(docs.sparkSession) as kept:
        info, cut = _cuts(narrow)
        changed = _joined(info, _results(cut, texts=True)).where(
            "doc_id is not null and (doc_id > rep or gone is not null)").select(
            F.col("doc_id").alias("_doc"), F.col("sha256").alias("_was"),
            F.when(F.col("doc_id") > F.col("rep"), F.lit("")).otherwise(F.col("left")).alias("_left"))
        changed = kept(changed.dropDuplicates(["_doc", "_was"]))
        del info, cut
    let_shuffles_go(docs.sparkSession)
    # The row travels as one struct, so that none of its columns can meet one of the join's.
    rows = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"))
    out = rows.join(changed, (F.col("row.doc_id") == F.col("_doc")) & (F.sha2(F.col("row.text"), 256) == F.col("_was")), "left")
    text = F.coalesce("_left", "row.text")
    columns = {"text": text, "n_chars": F.coalesce(F.length(text).cast("bigint"), F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return out.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
