"""N-gram Jaccard join by partition-and-enumerate signatures, and the components of its links.

Documents become sets of word shingles, and equal sets are one from the start. Sets whose overlap is at least 3/4 of their
union differ in at most a seventh of their joint size, and their sizes differ by at most a third.

*Bands.* Sizes are cut into bands. A set takes part in its own band's instance and, where a partner may be in the
next band, in that one too; every instance holds all linked pairs whose larger set lies in its band.

*Signatures.* An instance allows ``K`` differing elements. The element domain is cut by hash into ``n1`` partitions, more
than ``K / 2``, so two linked sets differ by at most one element in some partition. Each partition is cut again into
``n2`` parts, and all subsets of ``n2 - 1`` parts are enumerated: one of them is untouched by that one element, and gives both
sets the same signature.

*Walk.* A set emits its partitions in a fixed order only until it has met one more *solid* partition (no enumerated subset
empty) than can differ twice. All solid partitions in front of the first shared one differ twice in the pair, so both sets
reach it. Sets with too few solid partitions emit all, empty subsets included. No link is lost.

*Candidates.* Signatures are shuffled in compact blocks. Within a signature every set is paired with the smallest only; of
equal signatures within a task one travels. After these pairs are verified and joined to components, a second pass compares
the remaining pairs of a signature, those across components, with an exact lower bound of the difference (a parity sketch),
and verifies what is left. Copies are never expanded into all pairs.

*Wide signatures.* A phrase that very many texts hold is a signature of them all. Sets of a signature with more than ``WIDE``
members meet again by their rarest elements instead: in any order that all sets share, the first common element of two linked sets
lies among the first quarter of each, and one, since at least three quarters of the larger set are common and none of them comes
before. The order is by how often an element (its slot of a table of fixed size) occurs in these sets, rare ones first, so a phrase
is in hardly any quarter. Elements that more than ``WIDE`` sets still share are compared in tiles.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from speechloom.llm.batches import flat, in_rows, key_runs, mixed, ragged, seeded, sliced, words_of
from speechloom.llm.graphs import components
from speechloom.llm.grouped import with_group_values
from speechloom.llm.names import clashes, named, with_new_names
from speechloom.plans.blocks import checkpointed, inner_tables

SHINGLE = 5
GROWTH = 1.75
FEW = 64  # instances of smaller sets cut a partition into three parts
FLUSH = 1 << 20
SEEN = 1 << 20
TILE = 512
STAR = 256
WIDE = 256
SLOT_BITS, SLOT_ROWS = 16, 64
MIN_BITS = 7
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9),
        np.uint64(0x27D4EB2F165667C5), np.uint64(0xD6E8FEB86659FD93)]


def uppers() -> np.ndarray:
    """Largest size of each band."""
    out = [6]
    while out[-1] < 1 << 40:
        out.append(int(out[-1] * GROWTH))
    return np.array(out, np.int64)


UPPERS = uppers()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each word: chains of mixings over eight bytes at a time, keyed, so that texts cannot be
    made to share them without the key."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every byte on
    size = ends - starts
    lanes = [mixed(size.astype(np.uint64) * odd ^ seeded(key + i)) for i, odd in enumerate(_ODD[:2])]
    rows, at = np.arange(len(size)), 0
    while len(rows):
        left = size[rows] - at
        part = eight[starts[rows] + at]
        short = left < 8
        part[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        lanes[0][rows] = mixed(lanes[0][rows] ^ part)
        lanes[1][rows] = mixed((lanes[1][rows] + part) * _ODD[2])
        rows, at = rows[left > 8], at + 8
    return lanes


def shingle_lanes(texts: pa.Array, both: bool = True, key: int = 0) -> tuple[list[np.ndarray], list[int]]:
    """Hashes of all shingles in one or two independent lanes, and where each text's begin.

    The first lane is a chain of mixings, the second a sum, over different hashes of the words.
    """
    data, offsets = flat(texts)
    lower = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)
    starts, ends, first = words_of(lower, offsets)
    word = word_hashes(lower, starts, ends, key)
    count = np.diff(first)
    many = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    rows, at = ragged(many)
    begin, left = first[:-1][rows] + at, np.minimum(count[rows], SHINGLE)
    whole = bool((left == SHINGLE).all())
    lanes = []
    for lane in range(2 if both else 1):
        padded = np.append(word[lane], np.zeros(SHINGLE, np.uint64))
        gram = left.astype(np.uint64)
        for j, odd in enumerate(_ODD):
            part = padded[begin + j]
            if not whole:
                part = np.where(j < left, part, np.uint64(j + 1))
            gram = gram + part * odd if lane else (gram ^ part ^ gram >> np.uint64(29)) * odd
        lanes.append(mixed(gram))
    return lanes, np.concatenate([[0], np.cumsum(many)]).tolist()


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (first lane) of the distinct shingles of every text, sorted within each text, and their number."""
    (gram,), bounds = shingle_lanes(texts, both=False)
    sets = [distinct(gram[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return (np.concatenate(sets) if sets else gram), np.array([len(s) for s in sets], np.int64)


def named_sets(texts: pa.Array, renames: dict | None = None, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``shingle_sets`` with the two halves of a name: a digest over both lanes; 0 for empty sets."""
    lanes, bounds = shingle_lanes(texts, key=key)
    sets, digests = [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        sets.append(distinct(lanes[0][a:b]))
        digest = hashlib.blake2b(sets[-1].tobytes(), digest_size=16)
        digest.update(distinct(lanes[1][a:b]).tobytes())
        digests.append(digest.digest())
    sizes = np.array([len(s) for s in sets], np.int64)
    name, second = named(b"".join(digests), renames)
    return (np.concatenate(sets) if sets else lanes[0]), sizes, np.where(sizes > 0, name, 0), np.where(sizes > 0, second, 0)


def common(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[int, int]:
    """Size of the intersection and of the union of two sets given in two lanes each; what meets in one lane only is not equal."""
    size = [max(len(x) for x in side) for side in (a, b)]
    both = min(len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True))
    return both, size[0] + size[1] - both


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parity sketches, with at least twice as many bits as elements: sets differ in at least as many elements as their sketches
    differ in bits. Bits go by the leading bits of a hash, so a sketch folds to half its size."""
    power = np.maximum(MIN_BITS, np.ceil(np.log2(np.maximum(2 * sizes, 1)))).astype(np.int64)
    ends = np.cumsum(1 << power)
    rows, _ = ragged(sizes)
    at = (ends - (1 << power))[rows] + (mixed(hashes ^ _ODD[3]) >> (64 - power)[rows].astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8)
    body = np.packbits(odd).tobytes()
    return [body[a >> 3: b >> 3] for a, b in zip((ends - (1 << power)).tolist(), ends.tolist(), strict=True)]


def folded(bits: np.ndarray) -> np.ndarray:
    """Sketches (rows of bytes) of half the size."""
    pairs = np.unpackbits(bits, axis=1).reshape(len(bits), -1, 2)
    return np.packbits(pairs[:, :, 0] ^ pairs[:, :, 1], axis=1)


def may_link(i: np.ndarray, j: np.ndarray, n: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Which pairs of rows may link, by their sizes ``n`` and sketches; a pair that links is never refused."""
    on = (4 * n[i] >= 3 * n[j]) & (4 * n[j] >= 3 * n[i])
    size = np.array([len(x) for x in marks])
    out = np.zeros(len(i), bool)
    place = np.zeros(len(size), np.int64)
    table = {}
    for width in np.unique(size).tolist():
        rows = np.flatnonzero(size == width)
        place[rows] = np.arange(len(rows))
        table[width] = np.frombuffer(b"".join(marks[r] for r in rows.tolist()), np.uint8).reshape(len(rows), width)
    for low in table:
        for high in (low, 2 * low):
            if high not in table:
                continue
            wide = table[high] if high == low else folded(table[high])
            for x, y in ((i, j),) if high == low else ((i, j), (j, i)):
                at = np.flatnonzero(on & (size[x] == low) & (size[y] == high))
                for k in range(0, len(at), step := max(1, (8 << 20) // low)):
                    part = at[k: k + step]
                    differ = np.bitwise_count(table[low][place[x[part]]] ^ wide[place[y[part]]]).sum(axis=1, dtype=np.int64)
                    out[part] = 7 * differ <= n[x[part]] + n[y[part]]
    return out


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit signatures of sets, and the set each belongs to."""
    band = np.searchsorted(UPPERS, sizes)
    over = np.flatnonzero(4 * sizes // 3 > UPPERS[band])
    row_set = np.concatenate([np.arange(len(sizes)), over])
    inst = np.concatenate([band, band[over] + 1])
    top = UPPERS[inst]
    differ = (sizes[row_set] + np.minimum(top, 4 * sizes[row_set] // 3)) // 7
    on = differ > 0
    out_sig, out_set = [], []
    starts = np.cumsum(sizes) - sizes
    for parts, chosen in ((3, on & (top <= FEW)), (2, on & (top > FEW))):
        r = np.flatnonzero(chosen)
        if not len(r):
            continue
        sets, i = row_set[r], inst[r]
        most = 2 * top[r] // 7
        n1 = most // 2 + 1 + most // 24  # a few more than needed, for partitions that hold nothing
        need = differ[r] // 2 + 1
        rows, at = ragged(sizes[sets])
        element = hashes[starts[sets][rows] + at]
        spread = mixed(element ^ (i[rows].astype(np.uint64) * _ODD[4])) >> np.uint64(32)
        base = np.cumsum(n1 * parts) - n1 * parts
        slot = base[rows] + ((spread * (n1 * parts)[rows].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = int((n1 * parts).sum())
        order = np.zeros(total, np.uint64)
        np.add.at(order, slot, mixed(element ^ _ODD[0]))
        filled = (np.bincount(slot, minlength=total) > 0).reshape(-1, parts)
        content = order.reshape(-1, parts)
        owner, place = ragged(n1)
        subsets = [(0,), (1,)] if parts == 2 else [(0, 1), (0, 2), (1, 2)]
        full = np.stack([filled[:, s].any(axis=1) for s in map(list, subsets)], axis=1)
        solid = full.all(axis=1)
        met = np.concatenate([[0], np.cumsum(solid)])
        first = np.cumsum(n1) - n1
        walked = met[:-1] - met[first][owner] < need[owner]
        thin = (met[first + n1] - met[first] < need)[owner]
        tag = mixed(i[owner].astype(np.uint64) << np.uint64(40) | place.astype(np.uint64))
        for nth, subset in enumerate(subsets):
            emit = np.flatnonzero(walked & (full[:, nth] | thin))
            value = tag[emit] + np.uint64(nth)
            for c in subset:
                value = value * _ODD[2] + content[emit, c]
            out_sig.append(mixed(value) >> np.uint64(16))
            out_set.append(sets[owner[emit]])
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_set)


def set_table(docs: DataFrame, key: int) -> DataFrame:
    """``doc_id, n_shingles, name, name2, sketch`` of every text."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            hashes, sizes, name, second = named_sets(batch.column("_text"), key=key)
            bits = sketches(hashes, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(name), pa.array(second), pa.array(bits, pa.binary())],
                names=["doc_id", "n_shingles", "name", "name2", "sketch"])

    return docs.mapInArrow(describe, "doc_id bigint, n_shingles bigint, name bigint, name2 bigint, sketch binary")


def signature_blocks(docs: DataFrame, buckets: int, renames: dict, key: int = 0) -> DataFrame:
    """``bucket, block``: packed (signature, name, whether others in the task have it) rows; a negative bucket of its own holds each
    block of (signature, name, centre) rows of those others, which need no further grouping."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, turn = 0, TaskContext.get().partitionId() << 24

        def flushed() -> pa.RecordBatch:
            nonlocal held, size, turn
            sig, name = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size, turn = [], 0, turn + 1
            order = np.lexsort((name, sig))
            sig, name = sig[order], name[order]
            first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            run = np.diff(np.append(first, len(sig)))
            shared = np.repeat(run > 1, run)
            centre = np.repeat(name[first], run)
            keys, blocks = [], []
            if shared.any():
                keys.append(-turn)
                blocks.append(np.concatenate([sig[shared].view(np.int64), name[shared], centre[shared]]).astype("<i8").tobytes())
            sig, name, more = sig[first], name[first], (run > 1).astype(np.uint8)
            bucket = ((sig >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            six = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(sig)], strict=True):
                keys.append(int(bucket[a]))
                blocks.append(six[a:b].tobytes() + name[a:b].astype("<i8").tobytes() + more[a:b].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

        for batch in sliced(batches, "_text"):
            hashes, sizes, names, _ = named_sets(batch.column("_text"), renames, key)
            fresh = np.array([not (x in seen or seen.add(x)) for x in names.tolist()], bool) & (sizes > 0)
            if len(seen) > SEEN:
                seen.clear()
            rows = np.repeat(fresh, sizes)
            sig, owner = signatures(hashes[rows], sizes[fresh])
            held.append((sig, names[fresh][owner]))
            size += len(sig)
            if size >= FLUSH:
                yield flushed()
        if size:
            yield flushed()

    return docs.mapInArrow(emit, "bucket bigint, block binary")


def _members(table: pa.Table) -> pa.Table:
    """Rows of signatures that several sets share, each with the smallest name as centre. ``more``: the signature may have
    members beyond a single pair."""
    blocks = table.column("block").to_pylist()
    if blocks and table.column("bucket")[0].as_py() < 0:
        sig, name, centre = (np.concatenate(x) for x in zip(*[np.frombuffer(b, "<i8").reshape(3, -1) for b in blocks], strict=True))
        return pa.table({"sig": sig, "name": name, "centre": centre, "more": np.ones(len(sig), bool)})
    sigs, names, more = [], [], []
    for block in blocks:
        n = len(block) // 15
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = np.frombuffer(block, np.uint8, 6 * n).reshape(n, 6)
        sigs.append(wide.view("<i8").ravel())
        names.append(np.frombuffer(block, "<i8", n, 6 * n))
        more.append(np.frombuffer(block, np.uint8, n, 14 * n))
    sig, name, more = np.concatenate(sigs), np.concatenate(names), np.concatenate(more)
    order = np.lexsort((name, sig))
    sig, name, more = sig[order], name[order], more[order]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    any_more = np.maximum.reduceat(more, first) > 0
    new = np.append(True, (sig[1:] != sig[:-1]) | (name[1:] != name[:-1]))
    sig, name = sig[new], name[new]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    run = np.diff(np.append(first, len(sig)))
    shared = np.repeat(run > 1, run)
    return pa.table({"sig": sig[shared], "name": name[shared], "centre": np.repeat(name[first], run)[shared],
                     "more": np.repeat(any_more | (run > 2), run)[shared]})


def near_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a, b``) whose sizes and sketches do not rule a link out."""
    side = lambda c: sets.select(F.col("name").alias(c), F.col("n_shingles").alias("n_" + c), F.col("sketch").alias("s_" + c))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            n = np.concatenate([batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()])
            marks = batch.column("s_a").to_pylist() + batch.column("s_b").to_pylist()
            on = may_link(np.arange(count), np.arange(count, 2 * count), n, marks) if count else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(on))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(test, "a bigint, b bigint")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, key: int) -> DataFrame:
    """The pairs (``a, b``, names) that link, by exact comparison of the shingles of one document of each set.

    Only documents that a pair asks for travel, compressed. All partners of a set meet it in streams of at most
    about ``STAR`` rows, so a set with very many partners is compared in many tasks.
    """
    asked = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    wanted = asked.join(reps, "name").select("name", F.col("rep").alias("doc_id"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in sliced(batches, "_text"):
            hashes_of = [pack(t.encode()) if t else b"" for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hashes_of, pa.binary())], names=["doc_id", "packed"])

    packed = docs.mapInArrow(squeeze, "doc_id bigint, packed binary")
    texts = checkpointed(packed.join(wanted, "doc_id").dropDuplicates(["name"]).select("name", "packed"))
    stars = pairs.groupBy("a").agg(F.count("*").alias("_n")).select("a", F.ceil(F.col("_n") / STAR).cast("int").alias("_tiles"))
    centre = stars.join(texts.withColumnRenamed("name", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("tile"), F.lit(None).cast("bigint").alias("b"), "packed")
    partner = pairs.join(stars, "a").join(texts.withColumnRenamed("name", "b"), "b").select(
        "a", F.pmod(F.xxhash64("b"), F.col("_tiles").cast("bigint")).cast("int").alias("tile"), "b", "packed")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        met, base = None, None
        for batch in in_rows(batches):
            texts = pa.array([expand(p) if p else b"" for p in batch.column("packed").to_pylist()], pa.binary()).cast(pa.string())
            a, tile, b = (batch.column(c).to_pylist() for c in ("a", "tile", "b"))
            found, at = [], 0
            for part in sliced([pa.record_batch({"t": texts})], "t"):
                lanes, bounds = shingle_lanes(part.column("t"), key=key)
                for start, end in zip(bounds[:-1], bounds[1:], strict=True):
                    own = [distinct(x[start:end]) for x in lanes]
                    if b[at] is None:
                        met, base = (a[at], tile[at]), own
                    elif met == (a[at], tile[at]):
                        both, either = common(base, own)
                        if 100 * both >= 75 * either:
                            found.append((a[at], b[at]))
                    at += 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = centre.union(partner).repartition(width, "a", "tile").sortWithinPartitions("a", "tile", F.col("b").asc_nulls_first())
    return checkpointed(met.mapInArrow(compare, "a bigint, b bigint"))


def wide_sets(names: DataFrame, reps: DataFrame, docs: DataFrame, renames: dict, key: int) -> DataFrame:
    """``name, hashes``: the elements of the sets in ``names``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            hashes, sizes, name, _ = named_sets(batch.column("_text"), renames, key)
            ends = np.cumsum(sizes)
            same = np.flatnonzero(name == batch.column("name").to_numpy())  # other rows of the same id may have another text
            packed = [hashes[ends[i] - sizes[i]: ends[i]].tobytes() for i in same.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(name[same]), pa.array(packed, pa.binary())], names=["name", "hashes"])

    wanted = names.join(reps, "name").select("name", F.col("rep").alias("doc_id"))
    return checkpointed(docs.join(wanted, "doc_id").select("name", "_text").mapInArrow(emit, "name bigint, hashes binary"))


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes ^ _ODD[1]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_counts(elements: DataFrame) -> np.ndarray:
    """How many elements of all sets fall into each slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in in_rows(batches):
            data, _ = flat(batch.column("hashes"))
            held += np.bincount(slot_of(data.view("<u8")), minlength=1 << SLOT_BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLOT_ROWS), pa.int32()), pa.array([x.tobytes() for x in np.split(held, SLOT_ROWS)], pa.binary())], names=["at", "held"])

    def total(table: pa.Table) -> pa.Table:
        held = sum(np.frombuffer(x.as_py(), "<i8") for x in table.column("held"))
        return pa.table({"at": table.column("at").slice(0, 1), "held": pa.array([held.tobytes()], pa.binary())})

    kind = "at int, held binary"
    rows = elements.mapInArrow(count, kind).groupBy("at").applyInArrow(total, kind).orderBy("at").collect()
    return np.frombuffer(b"".join(bytes(r["held"]) for r in rows), "<i8") if rows else np.zeros(1 << SLOT_BITS, np.int64)


def rarest(hashes: np.ndarray, sizes: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rarest quarter of each set and one element more, and the set of each."""
    rows, at = ragged(sizes)
    order = np.lexsort((hashes, often[slot_of(hashes)], rows))
    first = at <= (sizes // 4)[rows]
    return hashes[order][first], rows[first]


def element_blocks(elements: DataFrame, buckets: int, often: np.ndarray) -> DataFrame:
    """``bucket, block`` of the rarest elements of each set, in the form of ``signature_blocks``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches, 4096):
            data, offsets = flat(batch.column("hashes"))
            element, owner = rarest(data.view("<u8"), np.diff(offsets) // 8, often)
            element, name = element >> np.uint64(16), batch.column("name").to_numpy()[owner]
            bucket = ((element >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            element, name, bucket = element[order], name[order], bucket[order]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else bucket
            six = element.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            blocks = [six[a:b].tobytes() + name[a:b].astype("<i8").tobytes() + b"\1" * (b - a)
                      for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(element)], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut.astype(np.int64)].astype(np.int64)), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    return elements.mapInArrow(emit, "bucket bigint, block binary")


def across(members: DataFrame, parts: DataFrame, sets: DataFrame, docs: DataFrame, reps: DataFrame, renames: dict, key: int) -> DataFrame:
    """Pairs of sets that share a signature with at least a third, lie in different components and may link."""

    def groups(rows: DataFrame, least: int) -> DataFrame:
        """``sig, name, part, family, _n`` of the groups with so many members that lie in several components."""
        placed = rows.select("sig", "name").join(parts, "name", "left").select("sig", "name", F.coalesce("component", "name").alias("part"))
        many = placed.groupBy("sig").agg(
            F.count("*").alias("_n"), F.min("name").alias("family"), F.min("part").alias("_low"), F.max("part").alias("_high")).where(
            (F.col("_n") >= least) & (F.col("_low") < F.col("_high"))).select("sig", "family", "_n")
        return checkpointed(placed.join(many, "sig").select("sig", "name", "part", "family", "_n"))

    mixed_ = groups(members.where("more"), 3)
    narrow = mixed_.where(F.col("_n") <= WIDE)
    wide = checkpointed(mixed_.where(F.col("_n") > WIDE).select("name").distinct())
    large = None
    if total := wide.join(sets, "name").agg(F.sum("n_shingles")).first()[0]:
        elements = wide_sets(wide, reps, docs, renames, key)
        buckets = max(1, -(-int(total) // (4 * FLUSH)))
        met = groups(element_blocks(elements, buckets, slot_counts(elements)).groupBy("bucket").applyInArrow(
            _members, "sig bigint, name bigint, centre bigint, more boolean"), 2)
        narrow, large = narrow.union(met.where(F.col("_n") <= WIDE)), met.where(F.col("_n") > WIDE)
    # Groups with the same smallest member share most of their pairs. They are dealt together, so that a pair is
    # reported once for all of them; those of a family with many names are dealt by themselves.
    dealt = narrow.drop("_n")
    tiles = checkpointed(dealt.groupBy("family").agg(
        F.ceil(F.approx_count_distinct("name") / TILE).cast("int").alias("_tiles"), F.count("*").alias("_rows")))
    share = lambda c: F.pmod(F.xxhash64(c), F.col("_tiles").cast("bigint")).cast("int")
    columns = ["sig", "name", "part", "family", "n_shingles", "sketch", "own", "low", "high"]
    tiled = with_group_values(dealt, tiles, ["family"], "_rows").withColumn("own", share("sig")).withColumns(
        {"low": F.col("own"), "high": F.col("own")}).join(sets, "name").select(columns)
    if large is not None:
        most = large.groupBy("family").agg(F.ceil(F.max("_n") / TILE).cast("int").alias("_tiles"))
        cut = large.join(most, "family").withColumn("own", share("name"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).withColumns(
            {"low": F.least("own", "other"), "high": F.greatest("own", "other")})
        tiled = tiled.union(cut.join(sets, "name").select(columns))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, seen = None, set()
        for rows in key_runs(batches, ["family", "low", "high", "sig"]):
            place = tuple(rows.column(c)[0].as_py() for c in ("family", "low", "high"))
            if place != tile:
                tile, seen = place, set()
            name, part, own = (rows.column(c).to_numpy() for c in ("name", "part", "own"))
            if rows.num_rows < 2 or (part == part[0]).all():
                continue
            if place[1] == place[2]:
                i, j = np.triu_indices(len(name), 1)
            else:
                low = own == place[1]
                i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(low), np.flatnonzero(~low)))
            on = part[i] != part[j]
            i, j = i[on], j[on]
            on = may_link(i, j, rows.column("n_shingles").to_numpy(), rows.column("sketch").to_pylist())
            low, high = np.minimum(name[i[on]], name[j[on]]), np.maximum(name[i[on]], name[j[on]])
            found = set(zip(low.tolist(), high.tolist(), strict=True)) - seen
            seen |= found
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    width = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = tiled.repartition(width, "family", "low", "high").sortWithinPartitions("family", "low", "high", "sig")
    return met.mapInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Documents link when their shingle sets overlap in at least 75 % of the union. ``component_id`` is the smallest id
    reachable by links. Empty and null texts, and texts without a word, have no shingles and stay alone. A row with a null
    id cannot be named by a link and stays alone, its component null. Repeated rows are linked like any copies. Other
    columns are not read; an empty table gives no rows.
    """
    with inner_tables(docs.sparkSession) as kept:
        docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("_text"))
        key = secrets.randbits(60)  # hashes of this run
        info = checkpointed(set_table(docs, key))
        docs = docs.where("doc_id is not null")
        sets = _sets(info)
        if renames := clashes(sets, info.where("n_shingles > 0")):
            info = with_new_names(info, renames)
            sets = _sets(info)
        total = sets.agg(F.sum("n_shingles")).first()[0] or 0
        buckets = max(1, -(-int(total) // (2 * FLUSH)))
        members = checkpointed(signature_blocks(docs, buckets, renames, key).groupBy("bucket").applyInArrow(
            _members, "sig bigint, name bigint, centre bigint, more boolean"))
        bounds = sets.select("name", "n_shingles", "sketch")
        reps = sets.select("name", "rep")
        stars = checkpointed(members.where("name <> centre").select(F.col("centre").alias("a"), F.col("name").alias("b")).distinct())
        links = verified(checkpointed(near_pairs(stars, bounds)), reps, docs, key)
        parts = components(links).withColumnRenamed("node", "name")
        # What a star has decided needs no second look.
        rest = checkpointed(across(members, parts, bounds, docs, reps, renames, key).join(stars, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            links = links.union(verified(rest, reps, docs, key))
            parts = components(links).withColumnRenamed("node", "name")
        placed = sets.select("name", "rep", "_rows").join(parts, "name", "left").select(
            "name", "rep", "_rows", F.coalesce("component", "name").alias("part"))
        heads = placed.groupBy("part").agg(F.min("rep").alias("component_id"))
        named_ = checkpointed(placed.join(heads, "part").select("name", "component_id", "_rows"))
        on = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
        found = with_group_values(info.where(on).select("doc_id", "n_shingles", "name"), named_, ["name"], "_rows")
        alone = info.where(~on).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return kept(found.select(*alone.columns).union(alone))


def _sets(info: DataFrame) -> DataFrame:
    """A row per name: the smallest document, size and sketch of its set, how many documents have it, and the bounds of second names."""
    return checkpointed(info.where("n_shingles > 0 and doc_id is not null").groupBy("name").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"),
        F.count("*").alias("_rows"), F.min("name2").alias("low2"), F.max("name2").alias("high2")))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are the smallest of their component, with their own columns; of rows with equal id all stay."""
    kept = near_duplicates(docs).where("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
