"""Jaccard join, vector join and substring removal against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from speechloom.llm import graphs, jaccard_join as jj, substring_dedup as sd, suffix_arrays as sa, vector_join as vj

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def smallest(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text):
    words = _WORD.findall((text or "").translate(_LOWER))
    return frozenset(tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard_truth(texts):
    sets, having, links = {d: shingles(x) for d, x in texts.items()}, collections.defaultdict(list), []
    for d, s in sets.items():
        common = collections.Counter(o for g in s for o in having[g])
        links += [(d, o) for o, k in common.items() if 100 * k >= 75 * (len(s) + len(sets[o]) - k)]
        for g in s:
            having[g].append(d)
    parts = smallest(links, sets)
    return {d: (len(s), parts[d]) for d, s in sets.items()}


def near_copies(seed, n=260):
    """Chains and groups of near copies of very different sizes, with shared passages."""
    r, words = random.Random(seed), [f"w{i}" for i in range(400)]
    common = [r.choice(words) for _ in range(60)]
    out = []
    while len(out) < n:
        base = [r.choice(words) for _ in range(int(5 * 1.4 ** r.randrange(14)))]
        for _ in range(r.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(r.randrange(1 + len(base) // 25)):
                copy[r.randrange(len(copy))] = r.choice(words)
            if r.random() < 0.3:
                copy += common
            if r.random() < 0.2:
                copy = copy[: int(len(copy) * 0.8) + 1]
            out.append(" ".join(copy))
    return dict(enumerate(out[:n]))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed):
    texts = near_copies(seed)
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.near_duplicates(rows).collect()}
    assert got == jaccard_truth(texts)


def test_jaccard_join_of_odd_rows(spark, docs, texts, no_docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.near_duplicates(docs).collect()}
    assert got == jaccard_truth(texts)
    assert jj.near_duplicates(no_docs).collect() == []
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, None)], "doc_id bigint, text string")
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in jj.near_duplicates(rows).collect()))) == [
        "(2, 0, 2)", "(3, 2, 3)", "(3, 2, 3)", "(None, 2, None)"]


def test_sets_of_wide_signatures_meet_by_rare_elements(spark, monkeypatch):
    monkeypatch.setattr(jj, "WIDE", 3)
    monkeypatch.setattr(jj, "TILE", 2)
    texts = near_copies(3)
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.near_duplicates(rows).collect()}
    assert got == jaccard_truth(texts)


def test_a_common_phrase_does_not_pair_all_texts_that_hold_it(spark, monkeypatch, tmp_path):
    plain = jj.may_link

    def counted(i, j, n, marks):
        import uuid

        (tmp_path / uuid.uuid4().hex).write_text(str(len(i)))
        return plain(i, j, n, marks)

    monkeypatch.setattr(jj, "may_link", counted)
    monkeypatch.setattr(jj, "WIDE", 16, raising=False)
    phrase = " ".join(f"p{i}" for i in range(30))
    texts = {d: f"{phrase} " + " ".join(f"x{d}y{i}" for i in range(50 + d % 3)) for d in range(700)}
    texts |= {700 + d: texts[d] + " more" for d in range(20)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.near_duplicates(rows).collect()}
    assert got == jaccard_truth(texts)
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) < 30 * len(texts)


def test_rarest_elements_of_linked_sets_meet():
    """Random pairs at the very edge of the threshold, under random orders."""
    rng = np.random.default_rng(6)
    for _ in range(1500):
        union = int(rng.integers(1, 200))
        common = -(-75 * union // 100)
        pool = rng.integers(0, 2**63, union, dtype=np.uint64)
        cut = common + int(rng.integers(0, union - common + 1))
        a, b = np.unique(pool[:cut]), np.unique(np.concatenate([pool[:common], pool[cut:]]))
        element, owner = jj.rarest(np.concatenate([a, b]), np.array([len(a), len(b)]), rng.integers(0, 9, 1 << jj.SLOT_BITS))
        assert set(element[owner == 0].tolist()) & set(element[owner == 1].tolist())


def test_signatures_are_shared_by_all_linked_sets():
    """Random pairs at the very edge of the threshold, of all sizes up to 400."""
    rng = np.random.default_rng(4)
    for _ in range(1500):
        union = int(rng.integers(2, 400))
        common = -(-75 * union // 100)
        pool = rng.integers(0, 2**63, union, dtype=np.uint64)
        cut = common + int(rng.integers(0, union - common + 1))
        a, b = np.unique(pool[:cut]), np.unique(np.concatenate([pool[:common], pool[cut:]]))
        if np.array_equal(a, b):
            continue
        sig, owner = jj.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist()), (union, common, cut)


def test_second_pass_finds_links_that_the_centre_lacks(spark):
    """Chains whose ends differ too much from the smallest set."""
    base = [f"x{i}" for i in range(120)]
    texts = {i: " ".join(base[3 * i: 3 * i + 60]) for i in range(20)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jj.near_duplicates(rows).collect()} == jaccard_truth(texts)


def test_first_of_each_keeps_columns(docs, texts):
    truth = jaccard_truth(texts)
    got = jj.first_of_each(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {d for d, (_, c) in truth.items() if d == c}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)]
    got = {x.node: x.component for x in graphs.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: c for n, c in smallest(edges, nodes).items() if n != c}
    assert graphs.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize(("n", "k"), [(1, 2), (2, 2), (40, 2), (300, 3), (2000, 2)])
def test_suffix_array(n, k):
    for seed in range(10):
        text = np.append(np.random.default_rng(seed).integers(1, k + 1, n), 0)
        raw = text.astype(np.uint8).tobytes()
        assert sa.suffix_array(text, n + 2).tolist() == sorted(range(n + 1), key=lambda i: raw[i:])


def test_suffix_array_sorts_on_only_what_is_equal(monkeypatch):
    text = np.append(np.random.default_rng(5).integers(1, 20, 20_000), 0).astype(np.int16)
    sizes, plain = [], np.argsort

    def counted(a, *args, **more):
        sizes.append(len(a) if a.dtype == np.int64 else 0)
        return plain(a, *args, **more)

    monkeypatch.setattr(sa.np, "argsort", counted)
    order = sa.suffix_array(text, 50)
    assert sum(sizes) < 10_000
    raw = text.astype(np.uint8).tobytes()
    assert order.tolist() == sorted(range(len(text)), key=lambda i: raw[i: i + 60])


def test_segments():
    r = random.Random(3)
    texts = ["".join(r.choice("ab é") for _ in range(n)).encode() for n in (0, 49, 50, 300, 0, 51, 700, 10, 64, 0)] + [b"ab" * 90]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    hashes = sd.gram_hashes(data)
    assert len({*hashes.tolist()}) == len({data[i: i + sd.GRAM].tobytes() for i in range(len(hashes))})
    want = []
    for t, text in enumerate(texts):
        base = offsets[t]
        places = [min(range(i, i + sd.LENGTH - sd.GRAM + 1), key=lambda j: (int(hashes[base + j]) >> 32, j)) for i in range(len(text) - sd.LENGTH + 1)]
        cuts = [i for i in range(len(places)) if not i or places[i] != places[i - 1]]
        want += [(base + a, base + b - 1, t) for a, b in zip(cuts, [*cuts[1:], len(places)], strict=True)] if places else []
    first, last, gram, text = sd.segments_of(data, offsets)
    assert list(zip(first.tolist(), last.tolist(), text.tolist(), strict=True)) == want
    # Equal windows have equal anchors, wherever they stand.
    known = {}
    for a, b, g in zip(first.tolist(), last.tolist(), gram.tolist(), strict=True):
        for i in range(a, b + 1):
            assert known.setdefault(data[i: i + sd.LENGTH].tobytes(), g) == g


def test_common_prefixes():
    data = np.random.default_rng(1).integers(97, 100, 400).astype(np.uint8)
    order = sa.suffix_array(np.append(data.astype(np.int64), 0), 500)
    order = order[order < 340]
    found, raw = sa.permuted_lcp(np.append(data, np.zeros(60, np.uint8)), order, 50), data.tobytes()
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        want = next((i for i in range(50) if raw[a + i: a + i + 1] != raw[b + i: b + i + 1]), 50)
        assert found[b] == want


def removal_truth(texts):
    first, out = {}, {}
    for d in sorted(texts):
        raw = (texts[d] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i: i + 50], d) < d:
                gone[i: i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeating(seed):
    r = random.Random(seed)
    letters = "abcdé日 \n"
    passages = ["".join(r.choice(letters) for _ in range(r.choice([49, 50, 51, 80, 200]))) for _ in range(12)] + ["a" * 60, "ab" * 40]
    make = lambda: "".join(r.choice([r.choice(passages), "".join(r.choice(letters) for _ in range(r.randrange(70)))])
                           for _ in range(r.randrange(8)))
    texts = {i: make() for i in range(150)}
    return texts | {150: texts[3], 151: None, 152: "", 153: "a" * 3000}


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_removal(spark, seed):
    texts = repeating(seed)
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.substring_cuts(rows).collect()}
    assert got == removal_truth(texts)


def test_substring_removal_of_odd_rows(spark, docs, texts, no_docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.substring_cuts(docs).collect()}
    assert got == removal_truth(texts)
    assert sd.substring_cuts(no_docs).collect() == []
    long = "q" * 10 + "w" * 60
    rows = spark.createDataFrame([(None, long), (3, long), (3, long), (4, long)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in sd.substring_cuts(rows).collect()) == [
        (0, 0, 0), (3, 0, 0), (3, 0, 0), (4, 70, 1)]


def test_cut_texts_keep_whole_characters(spark):
    texts = repeating(3)
    truth = removal_truth(texts)
    rows = spark.createDataFrame([(d, x, len(x or ""), "s") for d, x in texts.items()], "doc_id bigint, text string, n_chars bigint, left string")
    got = sd.cut_texts(rows)
    assert got.columns == rows.columns
    for r in got.collect():
        size, gone = truth[r.doc_id][:2]
        left = len((r.text or "").encode())
        assert size - gone <= left <= size and (left < size or gone < 8) and r.n_chars == len(r.text or "")


def vectors_truth(rows):
    seen = {}
    for v, label, e in rows:
        ok = label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e)
        seen[v] = (label, np.array(e, np.float32).astype(np.float64)) if ok else None
    links = [(a, b) for a, x in seen.items() for b, y in seen.items() if a < b and x and y and x[0] == y[0] and len(x[1]) == len(y[1])
             and x[1] @ y[1] / (np.sqrt(x[1] @ x[1]) * np.sqrt(y[1] @ y[1])) >= vj.COSINE]
    counts = collections.Counter(n for link in links for n in link)
    parts = smallest(links, seen)
    return {v: (counts[v], parts[v], parts[v] == v) for v in seen}


def vectors(seed, tile_group):
    rng = np.random.default_rng(seed)
    rows, v = [], 0
    for size in [1] * 60 + [2, 3, 5, 8, 40, tile_group]:
        base, label, noise = rng.standard_normal(64), int(rng.integers(0, 3)), rng.choice([0.0, 0.05, 0.12, 0.15, 0.2])
        for _ in range(size):
            rows.append((v, label, (base + noise * rng.standard_normal(64)).astype(np.float32).tolist()))
            v += 1
    rows += [(v, None, rows[0][2]), (v + 1, 1, None), (v + 2, 1, [0.0] * 64), (v + 3, 1, [float("nan")] * 64), (v + 4, 1, [None] * 64),
             (v + 5, 1, [float("inf")] + [1.0] * 63), (v + 6, 1, [1.0, 2.0]), (v + 7, 1, [2.0, 4.0]), (v + 8, 1, [])]
    return rows


@pytest.mark.parametrize(("seed", "tile"), [(1, 1024), (2, 16)])
def test_vector_join(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(vj, "TILE", tile)
    rows = vectors(seed, 120)
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").repartition(5)
    truth = vectors_truth(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vj.linked_vectors(table).collect()} == truth
    assert sum(n for n, _, _ in truth.values()) > 100


def test_vector_join_of_odd_rows(spark):
    schema = "vec_id bigint, label int, embedding array<float>, name string"
    assert vj.linked_vectors(spark.createDataFrame([], schema)).collect() == []
    e = [1.0, 0.5, 0.25]
    rows = spark.createDataFrame([(None, 1, e, "x"), (5, 1, e, "x"), (5, 1, e, "x"), (6, 1, e, "y")], schema)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vj.linked_vectors(rows).collect())
    assert got == [(0, 0, 0, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False)]


def test_sketches_bound_the_difference():
    """Pairs that link are never refused, also where the sketches have different sizes; disjoint sets are."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        union = int(rng.integers(2, 700))
        common = -(-75 * union // 100)
        pool = rng.integers(0, 2**63, union, dtype=np.uint64)
        cut = common + int(rng.integers(0, union - common + 1))
        a, b = np.unique(pool[:cut]), np.unique(np.concatenate([pool[:common], pool[cut:]]))
        n = np.array([len(a), len(b)])
        marks = jj.sketches(np.concatenate([a, b]), n)
        assert jj.may_link(np.array([0]), np.array([1]), n, marks).tolist() == [True]
        other = np.unique(rng.integers(0, 2**63, max(len(a), 40), dtype=np.uint64))
        n = np.array([len(other), len(other)])
        far = jj.sketches(np.concatenate([other, np.unique(rng.integers(0, 2**63, len(other), dtype=np.uint64))]), n)
        assert jj.may_link(np.array([0]), np.array([1]), n, far).tolist() == [False]
