"""Texts of Arrow batches as flat byte arrays, and what NumPy computes on them without a loop per row."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_ODD = 0x9E3779B97F4A7C15
_BASE, _INVERSE = np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker.

    Functions travel by value and start each task with fresh globals; what is costly to build and bounded in size is
    kept here for the next task of the same worker.
    """
    module = sys.modules.setdefault("_speechloom_worker_cache", types.ModuleType("_speechloom_worker_cache"))
    return module.__dict__


def give_back() -> None:
    """Return freed memory to the system, so that a worker which waits for its next task holds only what it caches."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``limit`` bytes of text; a longer text stands alone. Empty batches go."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(offsets_of(batch.column(column)))
        ends, total = [], 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                ends.append(i)
                total = 0
            total += size
        for start, end in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            yield batch.slice(start, end - start)
    give_back()


def in_rows(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``rows``, for compressed texts, whose size shows only when they are expanded."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def offsets_of(column: pa.Array) -> np.ndarray:
    """Start of every text in the data buffer, with the end of the last one; a null is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    raw = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    if not column.null_count:
        return raw
    # Slots of nulls may still span bytes: rebuild the offsets over what is not null.
    return offsets_of(column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after the other, and the start of each text with the end of the last."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    offsets = offsets_of(column)
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), offsets - offsets[:1]
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(seed: int) -> np.uint64:
    return mixed(np.array([(seed * _ODD + 1) % (1 << 64)], np.uint64))[0]


def distinct_slices(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For slices that lie end to end and begin at ``starts``: the number of each among the distinct ones, and these. Compared byte by byte."""
    coded = binary_array(data, np.append(starts, len(data)) if len(starts) else np.zeros(1), pa.large_binary()).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


class RangeHash:
    """64-bit hashes of any byte range of a flat array in constant time, equal for equal bytes in every batch.

    Texts that differ may be made to share one: good for dealing work, not for telling texts apart.
    """

    def __init__(self, data: np.ndarray, seed: int = 0):
        table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + seeded(seed))
        n = len(data)
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * power[:n], out=self.sums[1:])
        power[:] = _INVERSE
        power[0] = 1
        self.inverse = np.multiply.accumulate(power, out=power)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` bytes at each position that has so many."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[k:] - self.sums[:-k]) * self.inverse[: n - k + 1] + np.uint64(k))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+``, and the first word of each text with the number of all."""
    blank = _BLANK[data]
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(blank, out=inside[:-1])
    first = inside[:-1].copy()
    first[1:] &= blank[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    last = np.zeros(len(data), bool)
    if len(data):
        last[:] = inside[:-1] & ~inside[1:]
        at_cut = cuts[cuts > 0] - 1
        last[at_cut] = inside[at_cut]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of the given lengths laid end to end: the row of each element, and its place in the row."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the ranges that begin at ``starts``, laid end to end."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def binary_array(data: np.ndarray | bytes, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow array of slices of one buffer."""
    kind = kind or pa.binary()
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    offsets = np.ascontiguousarray(offsets, np.int64 if wide else np.int32)
    body = data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes()
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body)])


def key_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key from batches sorted by integer ``keys``; only the rows of the key in progress are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        columns = [rows.column(k).to_numpy() for k in keys]
        new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
        cut = np.flatnonzero(new).tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield rows.slice(a, b - a)
        held = rows.slice(cut[-1]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
