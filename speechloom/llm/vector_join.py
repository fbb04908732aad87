"""Near-duplicate vectors by a pigeonhole join over subspaces.

Unit vectors with cosine at least ``c`` lie within squared distance ``2 - 2c``. A fixed random rotation spreads that distance
evenly, and the rotated space is split into blocks of few dimensions. In at least one block two linked vectors
differ by no more than the block's share of the squared distance. So each block is joined by range on a grid, and the
union of the candidates, verified by the cosine of the given vectors in double precision, holds every link.

A pair may be found in several blocks; it counts in the first block that admits it. Within a block it meets in one
cell only: every vector is at home in a cell and visits the neighbouring cells behind its own that its range
touches. Cells with many vectors are cut into tiles, and pairs of tiles are separate work. A cell returns a number of links
and one parent per vector, never pairs. Equal vectors are one vector with a weight.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from speechloom.llm.batches import key_runs
from speechloom.llm.graphs import components
from speechloom.llm.grouped import with_group_values
from speechloom.plans.blocks import checkpointed, inner_tables

COSINE = 0.98
BLOCK_DIMS = 8
GRID_DIMS = 3
SEED = 3
TILE = 1024
_STRIP = 128


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for each number of dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int, per_block: int = BLOCK_DIMS) -> np.ndarray:
    """First dimension of each block, with the end of the last."""
    return np.append(np.arange(0, dims, per_block), dims)


def budgets(dims: int, cosine: float) -> np.ndarray:
    """Squared distance each block may use, by its share of the dimensions, with room for rounding."""
    return (2 - 2 * cosine) * np.diff(blocks_of(dims)) / dims * (1 + 1e-9) + 1e-12


def rotated(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Unit vectors in the rotated space; the same bits for a vector in any batch, so that every cell decides alike."""
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    return np.einsum("ij,jk->ik", unit, turn, optimize=False)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def cells_of(unique: DataFrame, cosine: float) -> DataFrame:
    """``cell, home, id, weight, vector``: every vector at home once in each block, and its visits."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for dims in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dims))
                label = part.column("label").to_numpy().astype(np.int64)
                space, bounds = rotated(_matrix(part.column("vector")), rotation(dims)), blocks_of(dims)
                rows = np.arange(part.num_rows)
                for block, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
                    reach = np.sqrt(budgets(dims, cosine)[block])
                    grid = space[:, a: min(b, a + GRID_DIMS)] / (2 * reach)
                    own, low, high = (np.floor(grid + d).astype(np.int64) for d in (0, -0.5 - 1e-9, 0.5 + 1e-9))
                    for side in itertools.product((0, 1), repeat=grid.shape[1]):
                        # The own cell, or in each dimension the neighbour that the range touches.
                        other = np.where(own > low, low, high)
                        cell = np.where(np.array(side, bool), other, own)
                        differs = cell - own
                        lead = np.take_along_axis(differs, np.argmax(differs != 0, axis=1)[:, None], 1)[:, 0]
                        home = not any(side)
                        on = rows if home else rows[(lead > 0) & ((differs != 0) == np.array(side, bool)).all(axis=1)]
                        if not len(on):
                            continue
                        key = np.stack([label[on], np.full(len(on), dims), np.full(len(on), block), *cell[on].T], axis=1)
                        picked = part.take(pa.array(on))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(list(key), pa.list_(pa.int64())), pa.array(np.full(len(on), home)), picked.column("id"),
                             picked.column("weight"), picked.column("vector")], names=["cell", "home", "id", "weight", "vector"])

    return unique.select("label", "id", "weight", "vector").mapInArrow(
        place, f"cell array<bigint>, home boolean, id bigint, weight bigint, vector {dict(unique.dtypes)['vector']}")


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def cell_links(rows: pa.Table, cosine: float) -> pa.RecordBatch | None:
    """Links and a parent for each vector of one cell, or of two tiles of it."""
    _, dims, block = rows.column("cell")[0].as_py()[:3]
    home, own = rows.column("home").to_numpy(), rows.column("own").to_numpy()
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    ids, weight = rows.column("id").to_numpy(), rows.column("weight").to_numpy()
    vectors = _matrix(rows.column("vector"))
    space, bounds, budget = rotated(vectors, rotation(dims)), blocks_of(dims), budgets(dims, cosine)
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    near = space[:, bounds[block]: bounds[block + 1]]
    square = np.einsum("ij,ij->i", near, near)
    n = len(ids)
    links, parent = np.zeros(n, np.int64), np.arange(n)
    for start in range(0, n, _STRIP):
        i = np.arange(start, min(start + _STRIP, n))
        loose = square[i][:, None] + square[None, start:] - 2 * near[i] @ near[start:].T <= budget[block] + 1e-6
        a, b = np.nonzero(loose)
        a, b = a + start, b + start
        on = (a < b) & (home[a] | home[b])
        if low != high:
            on &= own[a] != own[b]
        a, b = a[on], b[on]
        for at in range(0, len(a), 1 << 15):
            x, y = a[at: at + (1 << 15)], b[at: at + (1 << 15)]
            differ = np.add.reduceat((space[x] - space[y]) ** 2, bounds[:-1], axis=1) <= budget
            first = differ[:, block] & (np.argmax(differ, axis=1) == block)
            x, y = x[first], y[first]
            cos = np.einsum("ij,ij->i", vectors[x], vectors[y]) / (norm[x] * norm[y])
            x, y = x[cos >= cosine], y[cos >= cosine]
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            for u, v in zip(x.tolist(), y.tolist(), strict=True):
                u, v = _root(parent, u), _root(parent, v)
                if u != v:
                    u, v = (u, v) if ids[u] < ids[v] else (v, u)
                    parent[v] = u
    on = np.flatnonzero(links)
    if not len(on):
        return None
    roots = ids[[_root(parent, i) for i in on.tolist()]]
    return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(links[on]), pa.array(roots)], names=["id", "links", "parent"])


def _labelled(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector``: labels of any type as whole numbers, equal ones alike; components stay float or double."""
    kinds = dict(vectors.dtypes)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"), F.col("embedding").cast(
        "array<double>" if kinds["embedding"] == "array<double>" else "array<float>").alias("vector"))
    if kinds["label"] in ("tinyint", "smallint", "int", "bigint"):
        return rows.withColumn("label", F.col("label").cast("bigint"))
    codes = checkpointed(rows.where("label is not null").groupBy("label").agg(F.count("*").alias("_n")))
    codes = checkpointed(codes.withColumn("_code", F.monotonically_increasing_id()))
    return with_group_values(rows, codes, ["label"], "_n", how="left").select("vec_id", F.col("_code").alias("label"), "vector")


def linked_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors of one label link when their cosine is at least ``cosine``. Null labels, null or zero vectors and vectors with null or
    non-finite components link with nothing, and so do vectors of different length. A null id has no links, a null component and is kept.
    Repeated rows are one vector. Components may be float or double, labels of any type that has equality. Other columns are not read; an empty
    table gives no rows.
    """
    with inner_tables(vectors.sparkSession) as kept:
        return kept(_linked(vectors, cosine))


def _linked(vectors: DataFrame, cosine: float) -> DataFrame:
    rows = _labelled(vectors)
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
             & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists("vector", lambda x: x != 0))
    rows = checkpointed(rows.withColumn("name", F.when(F.coalesce(sound, F.lit(False)), F.sha2(F.concat_ws(
        ",", F.col("label").cast("string"), F.col("vector").cast("array<string>")), 256))))
    unique = checkpointed(rows.where("name is not null").groupBy("name").agg(
        F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("weight"), F.count("*").alias("_rows"),
        F.first("label").alias("label"), F.first("vector").alias("vector")))
    placed = cells_of(unique, cosine).withColumn("key", F.xxhash64("cell"))
    # The sizes of cells come from keys alone; only full cells are cut.
    full = placed.groupBy("key").agg(F.count("*").alias("_n")).where(f"_n > {TILE}").select(
        "key", F.ceil(F.col("_n") / TILE).cast("int").alias("_tiles"))
    tiled = placed.join(checkpointed(full), "key", "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("id"), F.col("_tiles").cast("bigint")).cast("int")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("other"))
    tiled = tiled.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in key_runs(batches, ["key", "low", "high"]):
            if run.num_rows > 1:
                # Cells whose keys collide are told apart.
                cells = run.column("cell").to_pylist()
                for cell in {tuple(c) for c in cells}:
                    found = cell_links(run.filter(pa.array([tuple(c) == cell for c in cells])), cosine)
                    if found is not None:
                        yield found

    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = tiled.select("key", "low", "high", "own", "cell", "home", "id", "weight", "vector").repartition(
        width, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    found = checkpointed(met.mapInArrow(compare, "id bigint, links bigint, parent bigint"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("id").alias("a"), F.col("parent").alias("b"))).withColumnRenamed("node", "id")
    named = checkpointed(unique.select("name", "id", "weight", "_rows").join(links, "id", "left").join(parts, "id", "left").select(
        "name", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "id").alias("component"), "_rows"))
    narrow = rows.select("vec_id", "name")
    alone = narrow.where("name is null").select("vec_id", F.lit(None).cast("bigint").alias("links"), F.lit(None).cast("bigint").alias("component"))
    found = with_group_values(narrow.where("name is not null"), named, ["name"], "_rows").select("vec_id", "links", "component")
    return found.union(alone).select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce("component", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {COSINE}),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
part AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN part USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
