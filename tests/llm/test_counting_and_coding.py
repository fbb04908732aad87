"""Token counts, the token store and sampled pieces against the libraries."""

from __future__ import annotations

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from speechloom.llm import piece_sampling as ps, token_counts as tc, token_store as ts, workload
from speechloom.llm.batches import flat


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(workload.byte_tokenizer())


def test_counts_equal_the_library(docs, texts, library):
    got = {r.doc_id: r for r in tc.token_counts(docs, workload.byte_tokenizer()).collect()}
    assert len(got) == len(texts)
    for doc, text in texts.items():
        want = len(library.encode(text or "", add_special_tokens=False).ids)
        row = got[doc]
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((text or "").encode()), want, want > 512)


def test_classes_of_all_characters(library):
    """Every code point falls into the class the library gives it."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)}!{chr(c)}" for c in random.Random(1).sample(points, 4000)]
    texts += [f"a{chr(c)}1{chr(c)}!{chr(c)}" for c in (*range(0x3000), 0x3000, 0xFEFF, 0x1F600, 0x10FFFF) if not 0xD800 <= c < 0xE000]
    want = [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert tc.count_batch(workload.byte_tokenizer(), pa.array(texts)).tolist() == want


@pytest.mark.parametrize("chunk", [1, 3, 17])
def test_chunks_compose(monkeypatch, library, chunk):
    r = random.Random(chunk)
    texts = ["".join(r.choice(["a", "the", "ing", " ", "'s", "1", "é", "aaaa", "\n"]) for _ in range(r.randrange(80))) for _ in range(300)]
    monkeypatch.setattr(tc, "CHUNK", chunk)
    want = [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert tc.count_batch(workload.byte_tokenizer(), pa.array(texts)).tolist() == want


def test_table_may_be_emptied(library):
    machine, _ = tc.compiled(workload.byte_tokenizer())
    machine.empty()
    assert tc.count_batch(workload.byte_tokenizer(), pa.array(["the thing"])).tolist() == [len(library.encode("the thing").ids)]


def test_store_equals_the_library(docs, texts, library):
    want, start = {}, 0
    for doc in sorted(texts):
        ids = [*library.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        want[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in ts.stored(docs, workload.byte_tokenizer()).collect()}
    assert got == want


def test_store_of_nothing_and_of_null_ids(spark, no_docs):
    assert ts.stored(no_docs, workload.byte_tokenizer()).collect() == []
    rows = spark.createDataFrame([(None, "b"), (None, None), (1, "a"), (1, "a")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.start, r.n_tokens) for r in ts.stored(rows, workload.byte_tokenizer()).collect())
    assert [x[0] for x in got] == [0, 0, 1, 1] and sorted(x[1] for x in got)[0] == 0 and got[2][1:] == (3, 2) and got[3][1:] == (5, 2)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 5000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 3000).astype(np.uint32)
    table = ts.Table(ts.Table.scaled(np.bincount(ids, minlength=10)))
    docs, counts, back = ts.unpack(ts.pack([7, None], np.array([n, 0]), ids, table), table)
    assert docs == [7, None] and counts.tolist() == [n, 0] and np.array_equal(back, ids)


def test_damage_is_found():
    ids = np.arange(200, dtype=np.uint32) % 7
    table = ts.Table(ts.Table.scaled(np.bincount(ids)))
    block = bytearray(ts.pack([1], np.array([200]), ids, table))
    block[-9] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        ts.unpack(bytes(block), table)


def test_scaled_frequencies():
    counts = np.array([0, 1, 10**12, 3])
    scaled = ts.Table.scaled(counts)
    assert scaled.sum() == 1 << ts.SCALE and scaled[0] == 0 and (scaled[1:] > 0).all()


def test_pieces_are_lossless_and_reproducible(docs, texts, no_docs):
    model = workload.piece_model()
    one = ps.sampled_pieces(docs, model)
    got = {r.doc_id: r for r in one.collect()}
    assert len(got) == len(texts) and all(r.lossless and r.n_pieces == len(r.piece_ids) for r in got.values())
    again = {r.doc_id: r.piece_ids for r in ps.sampled_pieces(docs.repartition(3), model).collect()}
    assert again == {d: r.piece_ids for d, r in got.items()}
    other = {r.doc_id: r.piece_ids for r in ps.sampled_pieces(docs, model, seed=9).collect()}
    assert other != again
    back = {r.doc_id: r.text for r in ps.decoded_texts(one, model).collect()}
    assert back == {d: x or "" for d, x in texts.items()}
    assert ps.sampled_pieces(no_docs, model).collect() == []


def test_pieces_spell_their_strings(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=workload.piece_model())
    pieces = ps.piece_model(workload.piece_model(), ps.THETA)
    text = next(x for x in texts.values() if x and len(x) > 500)
    data, offsets = flat(pa.array([text]))
    ids, _ = ps.sample_pieces(pieces, data, offsets, ps.row_keys(pa.array([1]), 1))
    spelled = b"".join(bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode()
                       for i in ids.tolist() for p in [library.id_to_piece(i)])
    assert spelled.decode() == text


@pytest.mark.parametrize("word", [" thing", "  a", "of the"])
def test_sampling_follows_the_path_weights(word):
    pieces = ps.piece_model(workload.piece_model(), ps.THETA)
    known = {bytes(pieces.bytes[pieces.begin[i]: pieces.begin[i] + pieces.size[i]]): i for i in range(259, len(pieces.size))}
    raw, weights = word.encode(), {}
    for cuts in itertools.product([0, 1], repeat=len(raw) - 1):
        bounds = [0, *[i for i, c in enumerate(cuts, 1) if c], len(raw)]
        parts = [raw[a:b] for a, b in itertools.pairwise(bounds)]
        if all(p in known for p in parts):
            weights[tuple(known[p] for p in parts)] = math.exp(sum(pieces.weight[known[p]] for p in parts))
    n = 20_000
    data, offsets = flat(pa.array([word] * n))
    ids, counts = ps.sample_pieces(pieces, data, offsets, ps.row_keys(pa.array(range(n)), 5))
    ends = np.cumsum(counts)
    seen = collections.Counter(tuple(ids[e - c: e].tolist()) for e, c in zip(ends.tolist(), counts.tolist(), strict=True))
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    for path, weight in weights.items():
        p = weight / total
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_marks_and_lines_are_cut_from_words():
    r = random.Random(9)
    bits = ["word", "Word", "don't", "'ll", "x's", "3.14", "555-2524", "a.b.c", "é.", "é", "u\u0301.", "a\u0301.", "\u0301,", "\u00a0", "\u2003", "\x85", "\u200b",
            "<|endoftext|>", "<|endoftext", "|>", "&&&", "***", "...", "日本。", "日", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", " ", "  ", "$5", "_a_", "½.", "²,", "\x00."]
    texts = ["", None] + ["".join(r.choice(bits) for _ in range(r.randrange(1, 30))) for _ in range(3000)]
    data, offsets = flat(pa.array(texts, pa.string()))
    encoder = ts.Encoder(workload.byte_tokenizer())
    ids, counts = encoder.encode(data, offsets)
    want = [x.ids for x in encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    # Words are asked for once, whatever stands behind them.
    words = [f" word{chr(97 + i)}" for i in range(20)]
    data, offsets = flat(pa.array(["".join(w + end for w in words) for end in ("", ".", ",", "!", "?", ";", "\n", ".\n", "...")], pa.string()))
    encoder.clear()
    encoder.encode(data, offsets)
    assert len(encoder.known) < 50


def test_ids_are_counted_over_many_batches(monkeypatch, spark, sf_dir):
    monkeypatch.setattr(ts, "BLOCK_IDS", 500)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60)
    texts = [x.text for x in docs.collect()]
    library = ts.Encoder(workload.byte_tokenizer()).library
    want = collections.Counter(i for x in texts for i in [*library.encode(x or "", add_special_tokens=False).ids, ts.END_ID])
    got = ts.id_counts(ts.tokenized(docs, workload.byte_tokenizer()))
    assert {i: n for i, n in enumerate(got.tolist()) if n} == dict(want)
