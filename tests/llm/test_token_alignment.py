"""Alignment of two tokenizations, against the libraries' own tokens and a plain merge."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from speechloom.llm import token_alignment as ta
from speechloom.llm.workload import byte_tokenizer, piece_model

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(byte_tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=piece_model()), ta.byte_letters()


def tokens(models, text):
    """Ids and bytes of both sides of a text, or nothing."""
    a, b, letters = models
    whole = (" " + text).encode()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    same = b"".join(x for _, x in left) == whole == b"".join(x for _, x in right)
    return (left, right) if text and same else ([], [])


def brute(models, rows):
    parts, held = [], Counter()
    for doc, text in rows:
        left, right = tokens(models, text or "")
        ends_a = np.cumsum([len(x) for _, x in left]).tolist()
        ends_b = {e: i for i, e in enumerate(np.cumsum([len(x) for _, x in right]).tolist())}
        links = [(i, ends_b[e]) for i, e in enumerate(ends_a) if e in ends_b]
        pairs = [(left[i][0], right[j][0]) for i, j in links]
        held.update(pairs)
        groups, i0, j0 = [], 0, 0
        for i, j in links:
            groups.append(",".join(str(x) for x, _ in left[i0: i + 1]) + "|" + ",".join(str(x) for x, _ in right[j0: j + 1]))
            i0, j0 = i + 1, j + 1
        parts.append((doc, len(left), len(right), groups, pairs))
    most = Counter()
    for (_, b), n in held.items():
        most[b] = max(most[b], n)
    return sorted(((d, a, b, len(g), len(p), sum(held[x] == most[x[1]] for x in p), sum(held[x] for x in p),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, p in parts), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def test_alignment_of_documents(spark, texts, docs, models):
    assert rows_of(ta.alignment(docs, byte_tokenizer(), piece_model())) == brute(models, texts.items())


def test_nulls_repeats_specials_and_clashing_names(spark, models):
    rows = [(None, "one two"), (None, "one two"), (4, "one two"), (4, "one two"), (5, None), (6, ""), (7, " "), (8, "a▁b"), (9, "x<|endoftext|>y"),
            (10, "<s> </s> <unk> <0x41>"), (11, "trailing  "), (12, " \n\t x"), (13, "a\x00b"), (14, "日本 語 é ñ"), (15, "ab" * 50_000), (16, "▁")]
    df = spark.createDataFrame([(d, t, 1, 2, "z") for d, t in rows], "doc_id bigint, text string, n_a int, block int, _text string").repartition(3)
    assert rows_of(ta.alignment(df, byte_tokenizer(), piece_model())) == brute(models, rows)


def test_empty_table(spark, no_docs):
    assert ta.alignment(no_docs, byte_tokenizer(), piece_model()).collect() == []


@pytest.mark.parametrize("lane_bytes", [1, 7, 1 << 20])
def test_lanes_of_any_length_give_the_same_links(lane_bytes):
    r = np.random.default_rng(lane_bytes)
    offsets = np.concatenate([[0], np.cumsum(r.integers(0, 400, 50))])
    a = np.unique(np.concatenate([r.integers(1, offsets[-1], 3000), offsets[1:]]))
    b = np.unique(np.concatenate([r.integers(1, offsets[-1], 2000), offsets[1:]]))
    a, b = a[a > 0], b[b > 0]
    got_a, got_b = ta.lockstep(a, b, *ta.lanes_of(offsets, lane_bytes))
    assert a[got_a].tolist() == b[got_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_a_block_is_a_small_row_and_a_worker_holds_few_units(spark, monkeypatch):
    letters = np.random.default_rng(5).integers(0x61, 0x7B, (64, 64 << 10)).astype(np.uint8)
    df = spark.createDataFrame([(i, bytes(row).decode()) for i, row in enumerate(letters)], "doc_id bigint, text string").coalesce(1)
    rows = ta.aligned_blocks(df, byte_tokenizer(), piece_model()).selectExpr("length(places) + 16 * size(pairs) as n").collect()
    assert max(r.n for r in rows) < 1 << 20  # random letters make the largest rows, twice as large before

    monkeypatch.setattr(ta, "MAX_UNITS", 100)
    memory = ta.Memory(ta.ByteModel(byte_tokenizer()))
    for i in range(5):
        units = [b" w%d" % n for n in range(30 * i, 30 * i + 60)]
        got = memory.places(units)
        assert len(memory.known) <= 100
        assert [memory.ids[memory.begins[p]: memory.begins[p + 1]].tolist() for p in got] == memory.model.encode([u.decode() for u in units])
    memory.places([b" w%d" % n for n in range(300)])
    assert len(memory.known) == 300
