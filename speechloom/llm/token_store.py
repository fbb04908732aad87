"""Token ids in an entropy-coded block format: written in document order, read back block by block.

*Coder.* A static range asymmetric numeral system. One frequency table, counted over all documents and scaled to
``2**SCALE``, serves every block. A block deals its ids over interleaved lanes; each lane is a coder of its own, so all
lanes advance together as NumPy vectors.

*Block.* Little-endian: magic, documents, ids, lanes; then document ids with a null flag each, ids per document, the
lanes' checkpoints (state and number of words of each lane, from which any lane can be decoded alone), the lanes' words,
and a CRC-32 of all that. A block holds whole documents and depends on no other block, so blocks decode in
parallel. Part files hold blocks in ascending order of document id; ``first_token`` of a block counts from its part's
first id.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from speechloom.llm.batches import distinct_slices, flat, sliced, spread, worker_cache
from speechloom.plans.blocks import checkpointed, dropped, inner_tables, shared_folder

END_ID = 0
SCALE = 20
BLOCK_IDS = 1 << 20
LANES = 4096
MAGIC = b"SLTB"
_HEAD = "<4sIQI"
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)
SLICE = 8 << 20
MAX_UNITS = 800_000
JOINT_UNITS = 64
TABLE_SCHEMA = "magic string, scale int, width int, ids array<int>, frequencies array<bigint>"
BLOCKS_SCHEMA = "part int, block int, first_token bigint, n_docs bigint, n_tokens bigint, payload binary"

_SOLID, _WORDLY = 1, 2


class Encoder:
    """The tokenizers library with a memory: the ids of each stretch of text between blanks are asked for once.

    The piece pattern of byte-level tokenizers never joins a sign to white space behind it, nor a letter or digit to
    punctuation behind it. So a text may be cut in front of white space that follows a visible character, and in front
    of a mark that follows an ASCII letter or digit; ids of the cuts laid end to end are ids of the text. An apostrophe, which
    may open a contraction, and what stands in added tokens are left joined.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for word, number in vocabulary.items():  # a letter of a byte-level word is a byte
            self.width[number] = len(word)
        for number, token in self.library.get_added_tokens_decoder().items():
            self.width[number] = len(token.content.encode())
        added = "".join(token.content for token in self.library.get_added_tokens_decoder().values())
        # Kinds of bytes: white space and marks lie two bits above what they are cut from.
        kinds = np.zeros(256, np.uint8)
        kinds[0x21: 0x7F] = _SOLID
        for c in range(0x21, 0x7F):
            if chr(c).isalnum():
                kinds[c] |= _WORDLY
            elif chr(c) not in "'" + added:
                kinds[c] |= _WORDLY << 2
        kinds[[0x20, *range(0x09, 0x0E)]] = _SOLID << 2
        kinds[0x80: 0xC0] = _SOLID << 4
        kinds[0xC3: 0xE0] = _SOLID << 5
        self.kinds = kinds.tobytes()
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begins, self.ids, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        if len(self.known) > MAX_UNITS:
            self.clear()
        cut = np.zeros(len(data), bool)
        if len(data) > 1:
            kind = np.frombuffer(data.tobytes().translate(self.kinds), np.uint8)
            # Two-byte characters behind the first two leads are never white space; a longer one is left joined.
            before = kind[:-1] & (_SOLID | _WORDLY)
            before[1:] |= (kind[1:-1] >> 4) & (kind[:-2] >> 5) & _SOLID
            cut[1:] = (kind[1:] >> 2) & before != 0
        sizes = np.diff(offsets)
        cut[offsets[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut)
        codes, units = distinct_slices(data, starts)
        place = self._places(units.to_numpy(zero_copy_only=False).tolist())
        begins, lengths = self.begins[place][codes], (self.begins[place + 1] - self.begins[place])[codes]
        ids = self.ids[spread(begins, lengths)]
        running = np.concatenate([[0], np.cumsum(lengths)])
        of_text = np.searchsorted(starts, offsets)
        return ids, running[of_text[1:]] - running[of_text[:-1]]

    def _places(self, units: list[bytes]) -> np.ndarray:
        known = self.known
        place = np.fromiter(map(known.get, units, repeat(-1)), np.int64, len(units))
        fresh_at = np.flatnonzero(place < 0)
        if len(fresh_at):
            # Cuts that white space opens and a visible sign closes may stand together in one request.
            new = [units[i] for i in fresh_at.tolist()]
            plain = np.array([(u[0] == 0x20 or 0x09 <= u[0] <= 0x0D) and 0x20 < u[-1] < 0x7F for u in new], bool)
            order = np.argsort(~plain, kind="stable")
            new, split = [new[i] for i in order.tolist()], int(plain.sum())
            texts = [b"".join(new[i: min(i + JOINT_UNITS, split)]).decode() for i in range(0, split, JOINT_UNITS)]
            texts += [u.decode() for u in new[split:]]
            got = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            fresh = np.fromiter(chain.from_iterable(got), np.uint32, sum(map(len, got)))
            # Tokens cover the bytes one after the other, so lengths tell which cut each belongs to.
            covered = np.concatenate([[0], np.cumsum(self.width[fresh])])
            lengths = np.diff(np.searchsorted(covered, np.concatenate([[0], np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))])))
            while self.used + len(fresh) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used: self.used + len(fresh)] = fresh
            self.begins = np.concatenate([self.begins, self.used + np.cumsum(lengths)])
            self.used += len(fresh)
            place[fresh_at[order]] = np.arange(len(known), len(known) + len(new))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        return place


def encoder(path: str) -> Encoder:
    cache = worker_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]


def with_ends(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``END_ID`` behind each document, and where each document starts."""
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(int(starts[-1]), END_ID, ids.dtype)
    out[spread(starts[:-1], counts)] = ids
    return out, starts


class Table:
    """Frequencies scaled to ``2**SCALE``; every id that occurs has at least 1."""

    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)])[:-1].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies.astype(np.int64))

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        """Frequencies of sum ``2**SCALE`` in proportion to the counts; what rounding leaves goes to the most frequent."""
        total, size = int(counts.sum()), 1 << SCALE
        if not total:
            return np.zeros(len(counts), np.int64)
        if np.count_nonzero(counts) > size:
            raise ValueError("more distinct ids than the scale can tell apart")
        out = np.where(counts > 0, np.maximum(1, np.floor(counts / total * size)), 0).astype(np.int64)
        rest = size - int(out.sum())
        order = np.argsort(-out, kind="stable")
        if rest >= 0:
            out[order[0]] += rest
        for i in order if rest < 0 else ():
            take = min(-rest, int(out[i]) // 2)
            out[i] -= take
            rest += take
            if not rest:
                break
        return out


def lanes_for(n: int) -> int:
    return max(1, min(LANES, n // 64))


def rans_encode(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States, number of words and words of the lanes; id ``i`` goes to lane ``i % lanes``."""
    lanes = lanes_for(len(ids))
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    words = np.zeros((lanes, steps * SCALE // 32 + 2), np.uint32)
    used = np.zeros(lanes, np.int64)
    shift, limit = np.uint64(SCALE), np.uint64(63 - SCALE)
    for step in range(steps - 1, -1, -1):
        symbols = ids[step * lanes: (step + 1) * lanes]
        m = len(symbols)
        f, x = table.freq[symbols], state[:m]
        full = np.flatnonzero(x >= f << limit)
        words[full, used[full]] = x[full].astype(np.uint32)
        used[full] += 1
        x[full] >>= _WORD
        q = x // f
        x[:] = (q << shift) + (x - q * f) + table.start[symbols]
    return state, used, words[np.arange(words.shape[1]) < used[:, None]]


def rans_decode(n: int, state: np.ndarray, used: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    lanes = len(state)
    out = np.zeros(n, np.uint32)
    state, at = state.copy(), np.cumsum(used)
    words = np.append(words, np.uint32(0))
    mask, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for start in range(0, n, lanes):
        m = min(lanes, n - start)
        x = state[:m]
        slot = x & mask
        symbols = table.symbol[slot]
        out[start: start + m] = symbols
        x[:] = table.freq[symbols] * (x >> shift) + slot - table.start[symbols]
        low = np.flatnonzero(x < _LOW)
        at[low] -= 1
        x[low] = (x[low] << _WORD) | words[at[low]]
    return out


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    state, used, words = rans_encode(ids, table)
    body = b"".join([
        struct.pack(_HEAD, MAGIC, len(doc_ids), len(ids), len(state)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids),
        counts.astype("<u4").tobytes(), state.astype("<u8").tobytes(), used.astype("<u4").tobytes(),
        words.astype("<u4").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(payload: bytes, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document and all ids of a block; a damaged block is an error."""
    body, check = payload[:-4], struct.unpack("<I", payload[-4:])[0]
    magic, n_docs, n, lanes = struct.unpack_from(_HEAD, body)
    if magic != MAGIC or zlib.crc32(body) != check:
        raise ValueError("damaged block of token ids")
    at = struct.calcsize(_HEAD)

    def take(kind: str, size: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(body, kind, size, at)
        at += got.nbytes
        return got

    keys, null, counts = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    state, used = take("<u8", lanes), take("<u4", lanes).astype(np.int64)
    words = take("<u4", int(used.sum()))
    doc_ids = [None if gone else key for key, gone in zip(keys.tolist(), null.tolist(), strict=True)]
    return doc_ids, counts.astype(np.int64), rans_decode(n, state, used, words, table)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, row, ids``: compressed ids of each text with the end id, in no particular order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches, "_text", SLICE):
            data, offsets = flat(batch.column("_text"))
            ids, starts = with_ends(*encoder(path).encode(data, offsets))
            kind = np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32
            raw, width = ids.astype(kind).tobytes(), kind().itemsize
            cells = [squeeze(raw[a * width: b * width]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows), pa.array(np.full(len(rows), width, np.int32)), pa.array(cells, pa.binary())],
                names=["doc_id", "row", "width", "ids"])

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("_text"))
    return narrow.mapInArrow(encode, "doc_id bigint, row bigint, width int, ids binary")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for doc, width, ids in zip(batch.column("doc_id").to_pylist(), batch.column("width").to_pylist(),
                                   batch.column("ids"), strict=True):
            yield doc, np.frombuffer(expand(ids.as_buffer()), "<u2" if width == 2 else "<u4")


def id_counts(coded: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(1, np.int64), [], 0

        def added() -> np.ndarray:
            got = np.bincount(np.concatenate(held), minlength=len(total))
            got[: len(total)] += total
            return got

        for _, ids in _cells(batches):
            held.append(ids)
            size += len(ids)
            if size >= BLOCK_IDS:
                total, held, size = added(), [], 0
        if held:
            total = added()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    found = (coded.select("doc_id", "width", "ids").mapInArrow(count, "id bigint, n bigint")
             .groupBy("id").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    out[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def write_store(docs: DataFrame, tokenizer: str, folder: str) -> np.ndarray:
    """Write all documents to ``folder`` in ascending order of id, with the shared frequencies; returns these.

    ``folder/table`` holds what a reader needs besides the blocks: magic, scale, the size of the id space, and the frequency of
    every id that occurs. ``folder/blocks`` holds the blocks.

    Rows without text hold the end id alone; null ids come first; rows of the same id follow one another in some order. An empty
    table gives an empty store. Texts pass Python once; the ids are cut off as a table, counted, and dealt by ranges of id.
    """
    coded = checkpointed(tokenized(docs, tokenizer))
    frequencies = Table.scaled(id_counts(coded))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = Table(frequencies), TaskContext.get().partitionId()
        docs_in, parts, size, first, block = [], [], 0, 0, 0

        def written() -> pa.RecordBatch:
            nonlocal docs_in, parts, size, first, block
            payload = pack(docs_in, np.array([len(p) for p in parts]), np.concatenate(parts), table)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first]),
                 pa.array([len(docs_in)]), pa.array([size]), pa.array([payload], pa.binary())],
                names=["part", "block", "first_token", "n_docs", "n_tokens", "payload"])
            docs_in, parts, size, first, block = [], [], 0, first + size, block + 1
            return out

        for doc, ids in _cells(batches):
            if parts and size + len(ids) > BLOCK_IDS:
                yield written()
            docs_in.append(doc)
            parts.append(ids)
            size += len(ids)
        if parts:
            yield written()

    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = coded.repartitionByRange(width, "doc_id", "row").sortWithinPartitions("doc_id", "row").select(
        "doc_id", "width", "ids").mapInArrow(encode, BLOCKS_SCHEMA)
    blocks.write.parquet(f"{folder}/blocks", compression="none")
    used = np.flatnonzero(frequencies)
    shared = [(MAGIC.decode(), SCALE, len(frequencies), used.tolist(), frequencies[used].tolist())]
    docs.sparkSession.createDataFrame(shared, TABLE_SCHEMA).coalesce(1).write.parquet(f"{folder}/table")
    return frequencies


def read_frequencies(spark: SparkSession, folder: str) -> np.ndarray:
    """The shared frequencies of a store, bounded by its vocabulary."""
    head = spark.read.schema(TABLE_SCHEMA).parquet(f"{folder}/table").first()
    if head is None or head["magic"] != MAGIC.decode() or head["scale"] != SCALE:
        raise ValueError(f"{folder} is no store of token ids that this reader knows")
    out = np.zeros(head["width"], np.int64)
    out[np.array(head["ids"], np.int64)] = head["frequencies"]
    return out


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` decoded from the blocks; ``start`` counts the ids of all documents before.

    A folder is all it needs, in any session.
    """
    frequencies = read_frequencies(spark, folder)
    blocks = spark.read.schema(BLOCKS_SCHEMA).parquet(f"{folder}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).toPandas()  # a row per part file
    sizes = np.zeros(int(totals["part"].max()) + 1 if len(totals) else 1, np.int64)
    sizes[totals["part"].to_numpy(np.int64)] = totals["n"].to_numpy(np.int64)
    offsets = np.cumsum(sizes) - sizes

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(frequencies)
        for batch in batches:
            for part, first, payload in zip(batch.column("part").to_pylist(), batch.column("first_token").to_pylist(),
                                            batch.column("payload"), strict=True):
                docs, counts, ids = unpack(payload.as_buffer().to_pybytes(), table)
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (b - n): 4 * b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(offsets[part] + first + ends - counts), pa.array(counts),
                     pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "first_token", "payload").mapInArrow(
        decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def stored(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The registered query: write a store into the shared folder, and read it back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    with inner_tables(spark) as kept:
        write_store(docs, tokenizer, folder)
        out = kept(read_store(spark, folder))
    dropped(spark, folder)
    return out
