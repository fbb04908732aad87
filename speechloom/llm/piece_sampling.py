"""Sampled SentencePiece segmentations, and decoding without loss.

All segmentations of a text into pieces form a lattice. Forward filtering sums the weights of all paths to every byte;
backward sampling then walks from the end and draws each arc in proportion to the weight of the paths through it, so a
segmentation is drawn exactly with its probability. The draw at a byte takes its random number from (seed, row key, byte
position): the same row gives the same pieces in any batch, partitioning or retry.

*Weights.* Pieces of a BPE model have ranks, not probabilities; a piece of rank ``r`` weighs ``(r + 1) ** -theta``. A
character that is no piece is spelled by its byte pieces.

*No loss.* A blank is the piece sign ``▁``. The text is not normalised, no blank is put in front, and a literal ``▁``
is spelled in bytes, so the pieces laid end to end are the text.

*Units.* Pieces hold the blank sign only at their start, so the lattice falls apart in front of every blank behind
another character; the parts are independent. Filtering runs once for each distinct part of a batch, all parts in
lockstep; drawing runs for all occurrences at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from speechloom.llm.batches import distinct_slices, flat, mixed, ragged, seeded, sliced, worker_cache

SEED = 8
THETA = 1.0
_SLICE = 1 << 20


class Pieces:
    """The pieces of a model as bytes, and a trie over their reversed bytes."""

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled, normal = {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                spelled[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.setdefault(piece.replace("▁", " ").encode(), i)
        if len(spelled) != 256:
            raise ValueError("the model has no byte pieces, so it cannot spell every text")
        self.byte_piece = np.array([spelled[b] for b in range(256)], np.int64)
        first = min(normal.values(), default=0)
        self.weight = np.zeros(model.get_piece_size())
        for i in normal.values():
            self.weight[i] = -theta * np.log(1.0 + i - first + 1)
        self.weight[self.byte_piece] = -theta * np.log(1.0 + model.get_piece_size())
        # Bytes of each piece, for decoding.
        strings = [b""] * model.get_piece_size()
        for word, i in normal.items():
            strings[i] = word
        for b, i in spelled.items():
            strings[i] = bytes([b])
        self.size = np.array([len(s) for s in strings], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        child: dict[int, int] = {}
        ends = [0]
        for word, i in normal.items():
            node = 0
            for byte in reversed(word):
                node = child.setdefault(node << 8 | byte, len(ends))
                if node == len(ends):
                    ends.append(0)
            ends[node] = i
        self.next = np.zeros(len(ends) << 8, np.int32)
        self.next[list(child)] = list(child.values())
        self.ends = np.array(ends, np.int64)
        self.longest = max(map(len, normal), default=0)
        inside = {b for word in normal for b in word}
        self.apart = np.array([b not in inside for b in range(256)])  # bytes that are in no piece
        self.apart[0x80:] = False
        self.blank_leads = all(b" " not in word[1:] or not word.strip(b" ") for word in normal)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the parts into which the lattices of the texts fall apart."""
        cut = np.zeros(len(data), bool)
        if len(data) > 1 and self.blank_leads:
            cut[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
            alone = self.apart[data]
            cut |= alone
            cut[1:] |= alone[:-1]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)

    def lattice(self, data: np.ndarray, starts: np.ndarray) -> Lattice:
        return Lattice(self, data, starts)


class Lattice:
    """Arcs that end at each byte of some units, with the chance of each given that a path ends there."""

    def __init__(self, pieces: Pieces, data: np.ndarray, starts: np.ndarray):
        n = len(data)
        lengths = np.diff(np.append(starts, n))
        _, rel = ragged(lengths)
        edge = np.ones(n + 1, bool)  # where characters begin
        edge[:n] = (data & 0xC0) != 0x80
        levels = np.argsort(rel.astype(np.uint16) if n and rel.max() < 1 << 16 else rel, kind="stable")
        # Node i is the place behind byte i; nodes are numbered level by level, so filtering runs over slices.
        number = np.empty(n, np.int64)
        number[levels] = np.arange(n)
        self.last = number[np.append(starts[1:], n) - 1] if n else starts
        live = np.flatnonzero(edge[1:])
        found = []
        node, at = np.zeros(len(live), np.int64), live.copy()
        left = rel[live] + 1
        for size in range(1, pieces.longest + 1):
            if not len(at):
                break
            node = pieces.next[node << 8 | data[at - size + 1]].astype(np.int64)
            on = node > 0
            node, at, left = node[on], at[on], left[on]
            piece = pieces.ends[node]
            hit = piece > 0
            if hit.any():
                found.append((at[hit], piece[hit], size))
            on = left > size
            node, at, left = node[on], at[on], left[on]
        # Characters that are no piece: one arc that spells them.
        head = np.flatnonzero(edge[:-1])
        tail = np.append(head[1:], n) - 1
        known = np.zeros(n, bool)
        for at, _, size in found:
            if size <= 4:
                whole = edge[at - size + 1]
                whole &= np.searchsorted(head, at, "right") - np.searchsorted(head, at - size, "right") == 1
                known[at[whole]] = True
        spelled = ~known[tail]
        width = (tail - head + 1)[spelled]
        at = tail[spelled]
        for size in np.unique(width).tolist():
            found.append((at[width == size], np.zeros(int((width == size).sum()), np.int64), int(size)))
        counts = np.zeros(n, np.int64)
        for at, _, _ in found:
            counts[at] += 1
        counts = counts[levels]
        self.begin = np.concatenate([[0], np.cumsum(counts)])
        total = int(self.begin[-1])
        self.piece, self.size = np.zeros(total, np.int64), np.zeros(total, np.int64)
        filled = self.begin[:-1][number]
        source = np.full(total, -1, np.int64)
        for at, piece, size in found:
            slot = filled[at]
            filled[at] += 1
            self.piece[slot], self.size[slot] = piece, size
            inner = rel[at] >= size
            source[slot[inner]] = number[at[inner] - size]
        self.source = source
        weight = np.where(self.piece > 0, pieces.weight[self.piece], self.size * pieces.weight[pieces.byte_piece[0]])
        forward = np.full(n, -np.inf)
        bounds = np.searchsorted(rel[levels], np.arange(int(rel.max()) + 2 if n else 1))
        score = np.empty(total)
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            a, b = self.begin[low], self.begin[high]
            if a == b:
                continue
            from_ = source[a:b]
            x = weight[a:b] + np.where(from_ < 0, 0.0, forward[from_])
            some = np.flatnonzero(np.diff(self.begin[low: high + 1]))
            cuts = self.begin[low: high][some] - a
            top = np.maximum.reduceat(x, cuts)
            top[np.isneginf(top)] = 0.0
            many = np.diff(np.append(cuts, b - a))
            mass = np.exp(x - np.repeat(top, many))
            whole = np.add.reduceat(mass, cuts)
            with np.errstate(divide="ignore", invalid="ignore"):
                forward[low + some] = np.log(whole) + top
                score[a:b] = np.where(np.repeat(whole, many) > 0, mass / np.repeat(whole, many), 0.0)
        self.forward = forward
        # Running chances within each node, arc by arc.
        self.chance = score
        first = np.flatnonzero(counts > 1)
        step = 1
        while len(first):
            at = self.begin[first] + step
            self.chance[at] += self.chance[at - 1]
            step += 1
            first = first[counts[first] > step]

    def draw(self, units: np.ndarray, ends: np.ndarray, key: np.ndarray, place: np.ndarray,
             length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled arcs for occurrences of units: byte behind each arc, and the arc.

        ``ends`` is where an occurrence ends in the batch, ``place`` in its text; ``key`` is its row's hash.
        """
        node, at = self.last[units], ends.copy()
        place, left = place.copy(), length.copy()
        outs, arcs = [], []
        while len(node):
            luck = (mixed(key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
            arc, stop = self.begin[node], self.begin[node + 1] - 1
            todo = np.flatnonzero((luck >= self.chance[arc]) & (arc < stop))
            while len(todo):
                arc[todo] += 1
                todo = todo[(luck[todo] >= self.chance[arc[todo]]) & (arc[todo] < stop[todo])]
            outs.append(at)
            arcs.append(arc)
            size = self.size[arc]
            left = left - size
            on = left > 0
            node = self.source[arc[on]]
            at, place, left, key = (at - size)[on], (place - size)[on], left[on], key[on]
        return np.concatenate(outs or [ends]), np.concatenate(arcs or [ends])


def piece_model(path: str, theta: float) -> Pieces:
    cache = worker_cache()
    if ("pieces", path, theta) not in cache:
        cache["pieces", path, theta] = Pieces(path, theta)
    return cache["pieces", path, theta]


def sample_pieces(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts end to end, and how many each text has. ``keys``: a 64-bit number per text."""
    n_texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n_texts, np.int64)
    starts = pieces.units(data, offsets)
    ends = np.append(starts[1:], len(data))
    codes, units = distinct_slices(data, starts)
    unit_data, unit_bounds = flat(units)
    lattice = pieces.lattice(unit_data, unit_bounds[:-1])
    owner = np.searchsorted(offsets, starts, "right") - 1
    out, arcs = lattice.draw(codes, ends, keys[owner], ends - offsets[owner], ends - starts)
    arc_at = np.full(len(data) + 1, -1, np.int64)
    arc_at[out] = arcs
    places = np.flatnonzero(arc_at >= 0)
    arcs = arc_at[places]
    piece, size = lattice.piece[arcs], lattice.size[arcs]
    many = np.where(piece > 0, 1, size)
    rows, nth = ragged(many)
    ids = piece[rows]
    bytewise = ids == 0
    if bytewise.any():
        ids[bytewise] = pieces.byte_piece[data[places[rows][bytewise] - size[rows][bytewise] + nth[bytewise]]]
    text = np.searchsorted(offsets, places - 1, "right") - 1
    return ids, np.bincount(text, many, n_texts).astype(np.int64)


def decode_pieces(pieces: Pieces, ids: np.ndarray) -> np.ndarray:
    """The bytes that piece ids stand for."""
    rows, at = ragged(pieces.size[ids])
    return pieces.bytes[pieces.begin[ids][rows] + at]


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    filled = ids.cast(pa.int64()).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False).astype(np.int64)
    return mixed(filled.view(np.uint64) ^ seeded(seed))


def sampled_pieces(docs: DataFrame, path: str, seed: int = SEED, theta: float = THETA) -> DataFrame:
    """``doc_id, n_bytes, n_pieces, piece_ids, lossless``: a sampled segmentation of every text, checked by decoding.

    Null and empty texts have no pieces. Rows with equal id and text get equal pieces; null ids share one key. Other columns
    are not read, an empty table gives no rows, and texts of any length are cut into units. No shuffle.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(path, theta)
        for batch in sliced(batches, "_text", _SLICE):
            data, offsets = flat(batch.column("_text"))
            ids, counts = sample_pieces(pieces, data, offsets, row_keys(batch.column("doc_id"), seed))
            bounds = np.concatenate([[0], np.cumsum(counts)])
            back = decode_pieces(pieces, ids)
            ends = np.concatenate([[0], np.cumsum(pieces.size[ids])])[bounds]
            same = np.diff(ends) == np.diff(offsets)
            if same.all():
                wrong = np.concatenate([[0], np.cumsum(back != data)])
                same = wrong[offsets[1:]] == wrong[offsets[:-1]]
            cells = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(counts), cells, pa.array(same)],
                names=["doc_id", "n_bytes", "n_pieces", "piece_ids", "lossless"])

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("_text"))
    return narrow.mapInArrow(
        encode, "doc_id bigint, n_bytes bigint, n_pieces bigint, piece_ids array<int>, lossless boolean")


def decoded_texts(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """``doc_id, text`` from piece ids; null ids give a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(path, THETA)
        for batch in batches:
            texts = [None if cell is None else decode_pieces(pieces, np.array(cell, np.int64)).tobytes().decode()
                     for cell in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    narrow = coded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("_ids"))
    return narrow.mapInArrow(decode, "doc_id bigint, text string")
