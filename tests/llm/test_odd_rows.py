"""Nulls, repeated rows, very long texts and empty tables, operator by operator."""

from __future__ import annotations

import random

from speechloom.llm import language_id as li, mixing, piece_sampling as ps, quality_rules as qr, token_counts as tc, token_store as ts, vector_join as vj
from speechloom.llm.workload import byte_tokenizer, piece_model

SCHEMA = "doc_id bigint, text string, source string, lang string"


def odd(spark):
    r = random.Random(4)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta's", "12", "é"]) for _ in range(60_000))
    rows = [(None, "one two", None, None), (None, "one two", "a", "en"), (3, "same", "a", "en"), (3, "same", "a", "en"), (3, "other", "b", "fr"),
            (5, None, "b", None), (6, "", None, "de"), (7, long, "a", "en"), (8, "x" * 300_000, "b", "fr")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_token_counts(spark, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_tokenizer())
    docs = odd(spark)
    want = sorted(((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in
                   ((r["doc_id"], r["text"]) for r in docs.collect())), key=repr)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tc.token_counts(docs, byte_tokenizer()).collect()), key=repr)
    assert got == want
    assert tc.token_counts(no_docs, byte_tokenizer()).collect() == []


def test_piece_sampling(spark):
    got = ps.sampled_pieces(odd(spark), piece_model()).collect()
    assert len(got) == 9 and all(r["lossless"] for r in got)
    same = [r["piece_ids"] for r in got if r["doc_id"] == 3 and r["n_bytes"] == 4]
    assert len(same) == 2 and same[0] == same[1]
    nulls = [r["piece_ids"] for r in got if r["doc_id"] is None]
    assert nulls[0] == nulls[1]


def test_token_store_of_a_document_larger_than_a_block(monkeypatch, spark):
    monkeypatch.setattr(ts, "BLOCK_IDS", 5000)
    docs = odd(spark)
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in ts.stored(docs, byte_tokenizer()).collect()), key=repr)
    counts = sorted(((r["doc_id"], r["n_tokens"] + 1) for r in tc.token_counts(docs, byte_tokenizer()).collect()), key=repr)
    assert got == counts


def test_mixing(spark):
    docs = odd(spark)
    got = mixing.mixed_copies(docs, {"a": 1.0, "b": 1.0}).groupBy("doc_id", "text").count().collect()
    drawn = {(r["doc_id"], r["text"]): r["count"] for r in got}
    # Rows of one id are drawn alike: the repeated row stands twice as often as it was drawn.
    assert drawn.get((3, "same"), 0) % 2 == 0
    assert {d for d, _ in drawn} <= {None, 3, 5, 7, 8}


def test_quality_rules(spark):
    got = sorted(((r["doc_id"], r["n_words"], r["kept"]) for r in qr.judged(odd(spark)).collect()), key=repr)
    assert [x for x in got if x[0] == 3] == [(3, 1, False)] * 3
    assert [x[1] for x in got if x[0] in (5, 6)] == [0, 0] and [x[1] for x in got if x[0] == 7] == [60_000]
    assert len([x for x in got if x[0] is None]) == 2


def test_page_languages(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = documents.where("lang = 'de'").first()["text"]
    page = f"<!-- {'c' * 9000} --><html lang='de'><body>{text}</body></html>"
    rows = [(None, "https://a.de/x", page), (1, "https://a.de/x", page), (1, "https://a.de/x", page), (2, None, None), (3, "", ""),
            (4, "https://b.fr/", "<html><body>" + (text + " ") * 300 + "</body></html>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = li.page_languages(pages, documents).collect()
    assert len(got) == 6
    assert [r["declared"] for r in got if r["page_id"] in (None, 1)] == ["de"] * 3
    assert {r["lang"] for r in got if r["page_id"] in (None, 1, 4)} == {"de"}
    assert li.page_languages(pages.where("page_id > 9"), documents).collect() == []
    assert li.page_languages(pages, documents.where("lang is null")).where("lang is not null").collect() == []


def test_vectors_of_doubles_under_text_labels(spark):
    """A difference that float cannot hold decides, and labels are compared as they are."""
    import math

    turn = math.acos(0.98)
    rows = [(1, [1.0, 0.0], "a"), (2, [math.cos(turn * (1 - 1e-9)), math.sin(turn * (1 - 1e-9))], "a"),
            (3, [math.cos(turn * (1 + 1e-9)), -math.sin(turn * (1 + 1e-9))], "a"), (4, [1.0, 0.0], "b"), (5, [1.0, 0.0], None), (6, [1.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vj.linked_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (2, 1)}


def test_a_hot_cell_of_many_tiles(monkeypatch, spark):
    monkeypatch.setattr(vj, "TILE", 8)
    rows = [(i, [1.0, i * 1e-5, 0.0], 1) for i in range(120)] + [(200 + i, [0.0, 1.0, i * 0.5], 1) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vj.linked_vectors(df).collect()}
    assert all(got[i] == (119, 0) for i in range(120)) and got[200][1] == 200
