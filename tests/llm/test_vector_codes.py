"""Vector codes by pivots, against plain search."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from speechloom.llm import vector_codes as vc


def brute(rows, rounds=6, entries=16, parts=8):
    """Sorted (vec_id, code, error, label_error, sha) of (vec_id, vector, label) rows."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = [[v[p * w: (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            got = [nearest(p, c[p])[1] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, g in zip(cut, got) if g == e]
                if mine:
                    new[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
        books = new
    final = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    labels = {}
    for (_, _, label), f in zip(kept, final):
        labels[label] = labels.get(label, 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), labels[label], sha) for (i, _, label), f in zip(kept, final)), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_codes_of_random_vectors(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(16)], r.choice([1, 2, None])) for i in range(300)]
    rows += [(1000, None, 1), (1001, [float("nan")] * 16, 2), (1002, [float("inf")] + [0.0] * 15, 2), (1003, [None] + [0.0] * 15, 2),
             (None, [0.5] * 16, 3), (5, rows[5][1], 1), (5, [0.25] * 16, None), (2000, [0.0] * 16, 1), (2001, [0.0] * 16, 1)]
    rows = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame([(*x, "a", 1) for x in rows], "vec_id bigint, embedding array<float>, label int, code string, _n int").repartition(4)
    assert rows_of(vc.vector_codes(df)) == brute(rows)


def test_double_vectors_and_text_labels(spark):
    rows = [(i, [((i * 7 + j * j) % 11) / 9 for j in range(8)], "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    assert rows_of(vc.vector_codes(df)) == brute(rows)


def test_fewer_rows_than_entries_and_none(spark):
    rows = [(i, [float(i % 2)] * 8, None) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert rows_of(vc.vector_codes(df)) == brute(rows)
    assert vc.vector_codes(df.where("vec_id > 9")).collect() == []


def test_one_length_is_asked(spark):
    df = spark.createDataFrame([(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], "vec_id bigint, embedding array<float>, label int")
    with pytest.raises(ValueError, match="one length"):
        vc.vector_codes(df)


def test_pivots_prune_without_a_change_of_result():
    r = np.random.default_rng(1)
    centres = r.integers(-3000, 3000, (16, 8))
    parts = np.stack([centres[r.integers(0, 16, 2000)] + r.integers(-40, 40, (2000, 8)) for _ in range(8)], axis=1)
    books = np.stack([centres + r.integers(-5, 5, centres.shape) for _ in range(8)])
    pivots = vc.fixed_pivots(books, 4)
    near = np.sqrt(vc.squared(parts[:, :, None], pivots[None]).astype(float)).astype(np.float32)
    got = vc.assign(parts, near, books, pivots)
    full = vc.squared(parts[:, :, None], books[None])
    assert (got.entry == full.argmin(2)).all() and (got.error == full.min(2)).all()
    assert got.evaluated < parts.shape[0] * 8 * 3  # of 16 each


def test_ties_go_to_the_lower_entry():
    parts = np.zeros((4, 8, 2), np.int64)
    books = np.stack([np.array([[5, 0], [3, 0], [-3, 0], [0, 3]])] * 8)
    pivots = vc.fixed_pivots(books, 2)
    near = np.sqrt(vc.squared(parts[:, :, None], pivots[None]).astype(float)).astype(np.float32)
    assert (vc.assign(parts, near, books, pivots).entry == 1).all()
