"""Alignment of two tokenizations of the same texts: common cuts, groups between them, and how often two ids end together.

*Tokens.* A text with a blank in front is encoded by a byte-level model (A) and a piece model (B, which adds the blank itself).
Texts are cut in front of blanks behind visible signs, where no token of either model can reach across, and each distinct
stretch is encoded once per worker.

*Lockstep.* Lanes are documents; a long one takes several lanes, each a range of its bytes. One state vector holds the A and B
pointers of all lanes. A step compares the ends of both tokens for all lanes: equal ends are a cut, both pointers advance and the pair
is a link; otherwise the pointer of the smaller end advances. Finished lanes are taken out. Where the ends of a lane's tokens
start is found by position, so lanes of one document need nothing from one another.

*Counts.* A block of documents keeps its links as places in its own list of distinct pairs. Only these lists are
shuffled: summed over the corpus, compared per B id, and sent back to their block, which then sums over its links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from speechloom.llm.batches import distinct_slices, flat, ragged, sliced, worker_cache
from speechloom.llm.grouped import with_group_values
from speechloom.plans.blocks import checkpointed, inner_tables, shuffle_width

# A block becomes one row, of about half its bytes for common texts: small rows spare the heap, small blocks the arrays of a worker.
BLOCK_BYTES = 512 << 10
LANE_BYTES = 1024
MAX_UNITS = 200_000
_SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: visible signs stand for themselves, the rest follow behind 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteModel:
    """A byte-level model of the tokenizers library; special strings in texts are plain text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        vocabulary, letters = self.library.get_vocab(with_added_tokens=True), byte_letters()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.bytes[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def encode(self, units: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(units, add_special_tokens=False)]


class PieceModel:
    """A piece model of the sentencepiece library, given units that open with the blank it would add itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        # Units are independent only if no piece goes on behind a visible sign with a blank.
        self.separable = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.blank = self.library.piece_to_id(_SPACE)

    def encode(self, units: list[str]) -> list[list[int]]:
        got = self.library.encode([u[1:] for u in units], num_threads=1)
        return [ids if len(u) > 1 else [self.blank] for u, ids in zip(units, got, strict=True)]


class Memory:
    """Ids and byte lengths of distinct units met by a worker, and whether its tokens join to the unit.

    It holds ``MAX_UNITS`` at most, or those of the last call where these are more, since it stays with the worker between tasks.
    """

    def __init__(self, model: ByteModel | PieceModel):
        self.model = model
        self.width = np.array([len(b) for b in model.bytes], np.int64)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begins, self.ids, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.int32), 0
        self.exact = np.zeros(0, bool)

    def places(self, units: list[bytes]) -> np.ndarray:
        """Where each of the distinct ``units`` stands."""
        new = [u for u in units if u not in self.known]
        if new and len(self.known) + len(new) > MAX_UNITS:
            self.clear()
            new = units
        known = self.known
        if new:
            got = self.model.encode([u.decode() for u in new])
            fresh = np.fromiter((i for ids in got for i in ids), np.int32)
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            joined = [b"".join([self.model.bytes[i] for i in ids]) == u for ids, u in zip(got, new, strict=True)]
            while self.used + len(fresh) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used: self.used + len(fresh)] = fresh
            self.begins = np.concatenate([self.begins, self.used + np.cumsum(lengths)])
            self.exact = np.append(self.exact, joined)
            self.used += len(fresh)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))


@dataclass
class Tokens:
    """Token ids of all documents end to end, the byte behind each token, where each document starts, and which are exact."""

    ids: np.ndarray
    ends: np.ndarray
    starts: np.ndarray
    exact: np.ndarray


def spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank in front of each that is not empty."""
    data, offsets = flat(column)
    sizes = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
    out = np.full(int(starts[-1]), 0x20, np.uint8)
    rows, at = ragged(sizes)
    out[starts[:-1][rows] + at + 1] = data
    return out, starts


def tokenized(data: np.ndarray, offsets: np.ndarray, memories: list[Memory]) -> list[Tokens]:
    """Tokens of the texts by each model."""
    cut = np.zeros(len(data), bool)
    if len(data) > 1 and all(getattr(m.model, "separable", True) for m in memories):
        solid = (data > 0x20) & (data < 0x7F)
        # Two-byte characters behind the first two leads are never white space; a longer one is left joined.
        solid[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        cut[1:] = (data[1:] == 0x20) & solid[:-1]
    sizes = np.diff(offsets)
    cut[offsets[:-1][sizes > 0]] = True
    starts = np.flatnonzero(cut)
    codes, found = distinct_slices(data, starts)
    units = found.to_pylist()
    of_text = np.searchsorted(starts, offsets)
    out = []
    for memory in memories:
        place = memory.places(units)[codes]
        lengths = memory.begins[place + 1] - memory.begins[place]
        rows, at = ragged(lengths)
        ids = memory.ids[memory.begins[place][rows] + at]
        running = np.concatenate([[0], np.cumsum(lengths)])[of_text]
        wrong = np.concatenate([[0], np.cumsum(~memory.exact[place])])[of_text]
        out.append(Tokens(ids, np.cumsum(memory.width[ids]), running, np.diff(wrong) == 0))
    return out


def only(tokens: Tokens, offsets: np.ndarray, use: np.ndarray) -> Tokens:
    """The tokens of the documents in ``use``; ends count from the start of the document, moved to ``offsets`` of the bytes."""
    counts = np.diff(tokens.starts) * use
    kept = np.repeat(use, np.diff(tokens.starts))
    base = np.concatenate([[0], tokens.ends])[tokens.starts[:-1]]
    moved = tokens.ends - np.repeat(base - offsets[:-1], np.diff(tokens.starts))
    return Tokens(tokens.ids[kept], moved[kept], np.concatenate([[0], np.cumsum(counts)]), use)


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, lanes: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens that end together, in order of their ends.

    A lane covers the ends above ``lanes`` and up to ``until``; both token lists end at the last byte of a document, which is
    the bound of its last lane.
    """
    a, b = np.searchsorted(a_ends, lanes, "right"), np.searchsorted(b_ends, lanes, "right")
    a_ends, b_ends = np.append(a_ends, np.iinfo(np.int64).max), np.append(b_ends, np.iinfo(np.int64).max)
    cut_a, cut_b = np.zeros(len(a_ends) - 1, bool), np.zeros(len(b_ends) - 1, bool)
    while len(a):
        left, right = a_ends[a], b_ends[b]
        active = np.minimum(left, right) <= until  # what both have left may be a common end only within the lane
        if not active.all():
            a, b, until, left, right = a[active], b[active], until[active], left[active], right[active]
        same = left == right
        cut_a[a[same]] = True
        cut_b[b[same]] = True
        a = a + (left <= right)
        b = b + (right <= left)
    return np.flatnonzero(cut_a), np.flatnonzero(cut_b)  # both ascend with the ends, so they stay paired


def lanes_of(offsets: np.ndarray, lane_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of at most ``lane_bytes`` that cover every document."""
    rows, at = ragged(-(-np.diff(offsets) // lane_bytes))
    begin = offsets[:-1][rows] + at * lane_bytes
    return begin, np.minimum(begin + lane_bytes, offsets[1:][rows])


class GroupText:
    """The text of all groups: ids in decimal, ``,`` between ids, ``|`` between A and B, ``;`` between groups."""

    def __init__(self, size: int):
        self.size = size
        self.cells = pa.array([f"{i}{sign}" for sign in ",|;" for i in range(size)], pa.large_binary())

    def digests(self, a: Tokens, b: Tokens, links_a: np.ndarray, links_b: np.ndarray) -> list[str]:
        """SHA-256 of each document's groups; without tokens nothing."""
        group_a = np.searchsorted(links_a, np.arange(len(a.ids)))
        group_b = np.searchsorted(links_b, np.arange(len(b.ids)))
        # In front of a token stand all tokens of its side before it and the other side's of earlier groups (B: of its own too).
        size_a, size_b = np.bincount(group_a, minlength=len(links_a)), np.bincount(group_b, minlength=len(links_a))
        before_a, before_b = np.cumsum(size_a), np.cumsum(size_b)
        sign_a, sign_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        sign_a[links_a], sign_b[links_b] = 1, 2
        cells = np.zeros(len(a.ids) + len(b.ids), np.int64)
        if len(links_a):
            cells[np.arange(len(a.ids)) + (before_b - size_b)[group_a]] = a.ids + sign_a * self.size
            cells[np.arange(len(b.ids)) + before_a[group_b]] = b.ids + sign_b * self.size
        text, ends = flat(self.cells.take(pa.array(cells)))
        whole = memoryview(text.tobytes())
        cuts = ends[a.starts + b.starts]
        return [hashlib.sha256(whole[x: y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _models(byte_path: str, piece_path: str) -> tuple[list[Memory], GroupText]:
    cache, key = worker_cache(), ("alignment", byte_path, piece_path)
    if key not in cache:
        memories = [Memory(ByteModel(byte_path)), Memory(PieceModel(piece_path))]
        cache[key] = memories, GroupText(max(len(m.model.bytes) for m in memories))
    return cache[key]


@dataclass
class Aligned:
    """Per document: tokens of each side, links, groups' digest; and the pair of ids of each link."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    pairs: np.ndarray


def aligned(column: pa.Array, memories: list[Memory], group_text: GroupText, lane_bytes: int = LANE_BYTES) -> Aligned:
    data, offsets = spaced(column)
    a, b = tokenized(data, offsets, memories)
    use = a.exact & b.exact & (np.diff(offsets) > 0)
    a, b = only(a, offsets, use), only(b, offsets, use)
    begin, until = lanes_of(offsets, lane_bytes)
    links_a, links_b = lockstep(a.ends, b.ends, begin, until)
    running = np.searchsorted(links_a, a.starts)
    return Aligned(np.diff(a.starts), np.diff(b.starts), np.diff(running), group_text.digests(a, b, links_a, links_b),
                   a.ids[links_a].astype(np.int64) << 32 | b.ids[links_b])


_BLOCK = ("block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_links array<bigint>, groups_sha256 array<string>, "
          "places binary, pairs array<bigint>, held array<bigint>")


def aligned_blocks(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """A row per block of documents: their facts, the block's distinct pairs with how often each is linked, and the links as places in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        memories, group_text = _models(byte_path, piece_path)
        block = TaskContext.get().partitionId() << 32
        for batch in sliced(batches, "_text", BLOCK_BYTES):
            got = aligned(batch.column("_text"), memories, group_text)
            coded = pa.array(got.pairs).dictionary_encode()
            places = coded.indices.to_numpy().astype(np.int32)
            one = [batch.column("doc_id"), pa.array(got.n_a), pa.array(got.n_b), pa.array(got.n_links), pa.array(got.digests, pa.string()),
                   coded.dictionary, pa.array(np.bincount(places, minlength=len(coded.dictionary)))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in one]
            squeezed = zstandard.ZstdCompressor(level=1).compress(places.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), *lists[:5], pa.array([squeezed], pa.binary()), *lists[5:]],
                names=["block", "doc_id", "n_a", "n_b", "n_links", "groups_sha256", "places", "pairs", "held"])
            block += 1

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("_text"))
    return narrow.mapInArrow(run, _BLOCK)


def pair_counts(held: DataFrame) -> DataFrame:
    """``pair, n, is_best, blocks`` of all pairs: links that hold it, whether no pair of its B id has more, and blocks that have it."""
    counts = checkpointed(held.groupBy("pair").agg(F.sum("held").alias("n"), F.count("*").alias("blocks")))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"), "blocks")


def _summed(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one block, with the sums over their links."""
    import zstandard

    block = blocks.to_batches()[0]
    order = np.argsort(answers.column("at").to_numpy())
    n, best = (answers.column(c).to_numpy()[order] for c in ("n", "is_best"))
    places = np.frombuffer(zstandard.ZstdDecompressor().decompress(block.column("places")[0].as_buffer()), np.int32)
    links = block.column("n_links").flatten()
    cuts = np.concatenate([[0], np.cumsum(links.to_numpy())])
    sums = [np.concatenate([[0], np.cumsum(v[places].astype(np.int64))])[cuts] for v in (best, n)]
    return pa.table({
        "doc_id": block.column("doc_id").flatten(), "n_a": block.column("n_a").flatten(), "n_b": block.column("n_b").flatten(),
        "n_groups": links, "n_links": links, "n_best": np.diff(sums[0]), "count_sum": np.diff(sums[1]),
        "groups_sha256": block.column("groups_sha256").flatten()})


def alignment(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: one row per row of ``docs``.

    A null or empty text, and one whose joined tokens differ from it, has zeros and no digest. A cut ends exactly one A and one
    B token, so there are as many links as groups. Null ids and repeated rows stay as they are, each counted as it occurs; a very long text is a
    block of its own; an empty table gives no rows; other columns are ignored.
    """
    with inner_tables(docs.sparkSession) as kept:
        blocks = checkpointed(aligned_blocks(docs, byte_path, piece_path))
        held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "x")).select(
            "block", "at", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
        counts = checkpointed(pair_counts(held))
        answers = with_group_values(held.select("block", "at", "pair"), counts, ["pair"], "blocks").select(
            F.col("block").alias("of"), "at", "n", F.col("is_best").cast("tinyint").alias("is_best"))
        facts = blocks.drop("pairs", "held").repartition(shuffle_width(docs), "block")
        return kept(facts.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(
            _summed, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"))
