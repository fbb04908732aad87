"""Exact duplicates by a tree merge of sorted digest runs.

*Runs.* Every task hashes its normalised texts and cuts them into runs of at most ``RUN_ROWS`` entries, sorted by digest
and without repeats: an entry is a digest, the text's length and a second checksum, the row that stays, and how many rows it
stands for. Entries are one only when digest, length and checksum agree.

*Rounds.* As many holders take part as there are runs, rounded up to a power of the fan-in. In round ``r`` holders
that differ in digit ``r`` of their number alone exchange: each cuts its run by that digit of the digest and sends
every partner its share, which merges what arrives into one sorted run. After all rounds a holder has every entry
of its digest range, no task ever holds more than about one run for each partner of it, and copies shrink to one
entry in the first round in which they meet. Each round is written to the shared folder: a lost executor repeats its round only.

*Answers.* Groups are joined back to the rows by digest; the few digests that many rows have are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from speechloom.llm.batches import flat, sliced
from speechloom.llm.grouped import with_group_values
from speechloom.plans.blocks import checkpointed, inner_tables

RUN_ROWS = 16_384
FAN_BITS = 4
#: An entry of a run; numbers of the digest are its big-endian quarters, so their order is that of the digest.
ENTRY = np.dtype([("d0", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("d3", "<u8"), ("bytes", "<i8"), ("check", "<u8"),
                  ("known", "<i8"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8")])
_KEY = ["d0", "d1", "d2", "d3", "bytes", "check"]
_RUNS = "holder bigint, n bigint, run binary"
_KEYS = "digest binary, n_bytes bigint, checksum bigint"


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of several: equal texts become one entry, the row with the largest id (null least), then row number, stays."""
    entries = np.concatenate(runs) if runs else np.zeros(0, ENTRY)
    order = np.lexsort([entries[c] for c in ("row", "id", "known", *reversed(_KEY))])
    entries = entries[order]
    last = np.ones(len(entries), bool)
    if len(entries):
        last[:-1] = np.logical_or.reduce([entries[c][1:] != entries[c][:-1] for c in _KEY])
        starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
        counts = np.add.reduceat(entries["n"], starts)
        entries = entries[last]
        entries["n"] = counts
    return entries


def digested(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, row, digest, n_bytes, checksum`` of every row; letters A-Z count as a-z, a null text as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches, "_text"):
            data, offsets = flat(batch.column("_text"))
            lower = memoryview(np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data).tobytes())
            cells = [lower[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            checks = np.fromiter((xxhash.xxh3_64_intdigest(c) for c in cells), np.uint64, len(cells))
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows), pa.array([hashlib.sha256(c).digest() for c in cells], pa.binary()),
                 pa.array(np.diff(offsets)), pa.array(checks.view(np.int64))],
                names=["doc_id", "row", "digest", "n_bytes", "checksum"])

    narrow = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("_text"))
    return narrow.mapInArrow(run, f"doc_id bigint, row bigint, {_KEYS}")


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(batch.num_rows, ENTRY)
    raw, _ = flat(batch.column("digest"))
    quarters = raw.reshape(-1, 32).copy().view(">u8")
    for i in range(4):
        out[f"d{i}"] = quarters[:, i]
    ids = batch.column("doc_id")
    out["known"] = ids.is_valid().to_numpy(zero_copy_only=False)
    out["id"] = ids.fill_null(0).to_numpy()
    out["row"], out["bytes"] = batch.column("row").to_numpy(), batch.column("n_bytes").to_numpy()
    out["check"] = batch.column("checksum").to_numpy().view(np.uint64)
    out["n"] = 1
    return out


def first_runs(rows: DataFrame, run_rows: int) -> DataFrame:
    """The sorted runs that each task makes of its own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def finished() -> pa.RecordBatch:
            nonlocal number, held, size
            out = merged(held)
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([number - 1]), pa.array([len(out)]), pa.array([out.tobytes()], pa.binary())], names=["holder", "n", "run"])

        for batch in batches:
            for start in range(0, batch.num_rows, run_rows):
                part = _entries(batch.slice(start, run_rows))
                if size and size + len(part) > run_rows:
                    yield finished()
                held.append(part)
                size += len(part)
        if size:
            yield finished()

    return rows.mapInArrow(run, _RUNS)


def exchanged(runs: DataFrame, bits: int, done: int, take: int) -> DataFrame:
    """A round: holders send each partner its share by ``take`` bits of the digest behind the first ``done``, and merge what they get."""
    low = bits - done - take  # the digit's place in the number of a holder

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for holder, run in zip(batch.column("holder").to_pylist(), batch.column("run"), strict=True):
                entries = np.frombuffer(run.as_buffer(), ENTRY)
                digit = (entries["d0"] >> np.uint64(64 - done - take)) & np.uint64((1 << take) - 1)
                cuts = np.searchsorted(digit, np.arange((1 << take) + 1))  # the run is sorted, and its earlier digits agree
                shares = [(d, entries[a:b]) for d, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                base = holder & ~(((1 << take) - 1) << low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base | d << low for d, _ in shares], pa.int64()), pa.array([len(s) for _, s in shares], pa.int64()),
                     pa.array([s.tobytes() for _, s in shares], pa.binary())], names=["holder", "n", "run"])

    def merge(table: pa.Table) -> pa.Table:
        out = merged([np.frombuffer(x.as_buffer(), ENTRY) for x in table.column("run")])
        return pa.table({"holder": table.column("holder")[:1], "n": pa.array([len(out)]), "run": pa.array([out.tobytes()], pa.binary())})

    return runs.mapInArrow(send, _RUNS).groupBy("holder").applyInArrow(merge, _RUNS)


def tree_merge(rows: DataFrame, run_rows: int = RUN_ROWS, fan_bits: int = FAN_BITS) -> DataFrame:
    """``digest, n_bytes, checksum, keep_id, keep_row, group_size`` of every distinct text of ``digested`` rows."""
    runs = checkpointed(first_runs(rows, run_rows))
    total = runs.agg(F.sum("n")).first()[0] or 0
    bits = max(1, (max(1, -(-total // run_rows)) - 1).bit_length())
    # The number of a holder says nothing about digests yet: runs are dealt evenly.
    runs = runs.withColumn("holder", F.pmod(F.xxhash64("holder"), F.lit(1 << bits)))
    done = 0
    while done < bits:
        take = min(fan_bits, bits - done)
        runs = checkpointed(exchanged(runs, bits, done, take))
        done += take

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column("run"):
                e = np.frombuffer(run.as_buffer(), ENTRY)
                raw = np.stack([e[f"d{i}"] for i in range(4)], axis=1).astype(">u8").tobytes()
                digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(e), [None, pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [digests, pa.array(e["bytes"].copy()), pa.array(e["check"].copy().view(np.int64)),
                     pa.array(e["id"].copy(), mask=e["known"] == 0), pa.array(e["row"].copy()), pa.array(e["n"].copy())],
                    names=["digest", "n_bytes", "checksum", "keep_id", "keep_row", "group_size"])

    return runs.select("run").mapInArrow(opened, f"{_KEYS}, keep_id bigint, keep_row bigint, group_size bigint")


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", run_rows: int = RUN_ROWS, fan_bits: int = FAN_BITS,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``, whatever its other columns are called.

    Texts are equal when they are identical after lower-casing A-Z; a null text is empty. Of equal texts the row with
    the largest id stays, a null id being the least; of repeated rows with that id exactly one stays. An empty table gives no rows.
    """
    with inner_tables(docs.sparkSession) as kept:
        rows = checkpointed(digested(docs, id_column, text_column))
        groups = checkpointed(tree_merge(rows, run_rows, fan_bits))
        # What stands alone needs no partner; only groups travel to their rows.
        found = with_group_values(rows, groups.where("group_size > 1"), ["digest", "n_bytes", "checksum"], "group_size", how="left")
        alone = F.col("group_size").isNull()
        return kept(found.select(
            "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
            (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256")))


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""
