"""Vectors compressed to codes of codebook entries in whole numbers, the nearest entry found by pivots (LAESA).

*Parts.* A vector becomes integers ``floor(SCALE * x)`` and is cut into ``PARTS`` equal parts; each part position has a
codebook of up to ``ENTRIES`` entries, moved for a number of rounds to the means of their parts.

*Pivots.* Each part position has a few fixed pivots, taken from its first codebook farthest first. The distances of all
parts to their pivots are computed once and stored with the parts. A round computes the distances of the entries to the pivots; by the
triangle inequality the largest difference of two such distances bounds the distance of part and entry from below. A
part evaluates entries in ascending order of that bound, exactly and in integers, and stops at the first bound above its best
distance. All parts of a batch take that step together, and those that are done leave.

*Rounds.* A task sums the parts of each entry before anything is shuffled, so a round moves ``PARTS * ENTRIES`` rows a
task, and only the codebooks, of fixed size, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from speechloom.llm.grouped import with_group_values
from speechloom.plans.blocks import checkpointed, inner_tables

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 4
#: Components at or above this size have no place in 64-bit sums of squares.
COMPONENT_LIMIT = 1 << 27
BATCH_ROWS = 8192
#: Bounds come from rounded square roots; they are lowered by this share of the distances they come from.
SLACK = 1e-6


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, ints``: rows whose vector has no null and no non-finite component, in whole numbers.

    Vectors of different lengths, of a length that does not divide into ``PARTS``, or with components beyond
    ``COMPONENT_LIMIT`` are an error when they are read.
    """
    v = F.col("embedding").cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    x = F.transform(v, lambda x: F.when(
        F.abs(x) < F.lit(COMPONENT_LIMIT / SCALE), F.floor(x * F.lit(float(SCALE))).cast("bigint")).otherwise(
        F.raise_error(F.lit(f"a component is beyond {COMPONENT_LIMIT // SCALE}")).cast("bigint")))
    return vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", "label", x.alias("ints"))


def parts_of(column: pa.Array) -> np.ndarray:
    """The parts of all vectors of a batch: vectors x parts x numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), PARTS, -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def fixed_pivots(first: np.ndarray, count: int) -> np.ndarray:
    """``PARTS x count`` entries of the first codebooks (``PARTS x entries x numbers``), each the farthest from those before it."""
    chosen = []
    for book in first:
        at, gap = [0], squared(book, book[0])
        while len(at) < min(count, len(book)):
            at.append(int(np.argmax(gap)))
            gap = np.minimum(gap, squared(book, book[at[-1]]))
        chosen.append(book[at])
    return np.stack(chosen)


@dataclass
class Assigned:
    """Entry and squared distance of each part, and how many exact distances were computed."""

    entry: np.ndarray
    error: np.ndarray
    evaluated: int


def assign(parts: np.ndarray, to_pivots: np.ndarray, books: np.ndarray, pivots: np.ndarray) -> Assigned:
    """The nearest entry of each part, ties to the lower index. ``to_pivots`` holds vectors x parts x pivots distances."""
    n, positions, _ = parts.shape
    entry, error = np.zeros((n, positions), np.int64), np.zeros((n, positions), np.int64)
    evaluated = 0
    for j in range(positions):
        x, book = parts[:, j], books[j]
        from_pivots = np.sqrt(squared(book[:, None], pivots[j][None]).astype(np.float64))
        near = to_pivots[:, j].astype(np.float64)
        bound = np.zeros((n, len(book)))
        for k in range(near.shape[1]):
            far = from_pivots[:, k]
            np.maximum(bound, np.abs(near[:, k, None] - far) - SLACK * (near[:, k, None] + far), out=bound)
        order = np.argsort(bound, axis=1, kind="stable")
        least = np.square(np.take_along_axis(bound, order, 1))
        best, place = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        rows = np.arange(n)
        for step in range(len(book)):
            rows = rows[least[rows, step] <= best[rows]]  # the others' remaining bounds are larger still
            if not len(rows):
                break
            tried = order[rows, step]
            got = squared(x[rows], book[tried])
            evaluated += len(rows)
            better = (got < best[rows]) | ((got == best[rows]) & (tried < place[rows]))
            at = rows[better]
            best[at], place[at] = got[better], tried[better]
        entry[:, j], error[:, j] = place, best
    return Assigned(entry, error, evaluated)


def with_pivot_distances(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The vectors as 32-bit numbers with the distance of each part to each of its pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            parts = parts_of(batch.column("ints"))
            near = np.sqrt(squared(parts[:, :, None], pivots[None]).astype(np.float64)).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), _lists(parts.reshape(len(parts), -1).astype(np.int32)),
                 _lists(near.reshape(len(near), -1))], names=["vec_id", "label", "ints", "near"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(
        run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, ints array<int>, near array<float>")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _near(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("near").flatten().to_numpy().reshape(batch.num_rows, PARTS, -1)


def moved(stored: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    _, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS * entries, width), np.int64)
        count = np.zeros(PARTS * entries, np.int64)
        for batch in _cut(batches):
            parts = parts_of(batch.column("ints"))
            cell = assign(parts, _near(batch), books, pivots).entry + np.arange(PARTS) * entries
            np.add.at(total, cell.ravel(), parts.reshape(-1, width))
            count += np.bincount(cell.ravel(), minlength=PARTS * entries)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(count[used]), _lists(total[used])], names=["cell", "n", "total"])

    # At most PARTS * ENTRIES rows reach the driver.
    got = (stored.select("ints", "near").mapInArrow(sums, "cell bigint, n bigint, total array<bigint>")
           .groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)])
           .collect())
    out = books.copy()
    for row in got:
        out[row["cell"] // entries, row["cell"] % entries] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return out


def coded(stored: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` by the final codebooks."""
    hexed = np.array([f"{i:02x}" for i in range(books.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            got = assign(parts_of(batch.column("ints")), _near(batch), books, pivots)
            codes = ["".join(row) for row in hexed[got.entry].tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(got.error.sum(1))],
                names=["vec_id", "label", "code", "error"])

    kinds = dict(stored.dtypes)
    return stored.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, pivots: int = PIVOTS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of all rows whose vector is whole (``whole_vectors``).

    The first codebooks are the parts of the smallest ids, null ids last and rows of one id in order of their numbers; with fewer rows
    than ``entries`` there are fewer entries. ``label_error`` sums over the rows of an equal label, nulls together. Repeated
    rows count as often as they occur. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    with inner_tables(spark) as kept:
        whole = checkpointed(whole_vectors(vectors))
        sizes = whole.agg(F.min(F.size("ints")).alias("least"), F.max(F.size("ints")).alias("most")).first()
        if sizes["least"] is None:
            return spark.createDataFrame(
                [], f"vec_id {dict(vectors.dtypes)['vec_id']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
        if sizes["least"] != sizes["most"] or sizes["most"] % PARTS:
            raise ValueError(f"vectors have {sizes['least']} to {sizes['most']} components; one length, in {PARTS} equal parts, is needed")
        # A fixed number of rows by their ids.
        starts = whole.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
        books = np.array([r["ints"] for r in starts], np.int64).reshape(len(starts), PARTS, -1).transpose(1, 0, 2)
        fixed = fixed_pivots(books, pivots)
        stored = checkpointed(with_pivot_distances(whole, fixed))
        for _ in range(rounds):
            books = moved(stored, books, fixed)
        codes = checkpointed(coded(stored, books, fixed))
        labels = checkpointed(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")))
        return kept(with_group_values(codes, labels, ["label"], "_n").select(
            "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")))


def oracle() -> str:
    """The same in SQL, one set of tables per round."""
    dist = "list_sum(list_transform(generate_series(1, len(p.v)), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))"
    steps = [f"""
x AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM x),
parts AS MATERIALIZED (SELECT r, g AS part, v[g * len(v) // {PARTS} + 1 : (g + 1) * len(v) // {PARTS}] AS v
  FROM p, generate_series(0, {PARTS - 1}) AS t(g)),
starts AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM p
  QUALIFY row_number() OVER (ORDER BY vec_id NULLS LAST, v) <= {ENTRIES}),
b0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN starts USING (r))"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT r, part, min({{'d': d, 'e': entry}}) AS best FROM (
  SELECT p.r, p.part, b.entry, CAST({dist} AS BIGINT) AS d FROM parts p JOIN b{k} b USING (part)) GROUP BY r, part)""")
        if k < ROUNDS:
            steps.append(f"""
s{k} AS (SELECT part, a.best.e AS entry, pos, CAST(sum(z) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT r, part, generate_subscripts(v, 1) AS pos, unnest(v) AS z FROM parts) JOIN a{k} a USING (r, part) GROUP BY ALL),
m{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM s{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry))""")
    steps.append(f"""
codes AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT h FROM digest) AS codebooks_sha256
FROM codes JOIN p USING (r)""")
    return "WITH" + ",".join(steps)


ORACLE = oracle()
