"""Texts built to share hashes, names that clash, columns that meet, pages with long openings, tables left behind."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from test_matching import removal_truth

import corpus_pipeline
from speechloom.llm import batches, jaccard_join as jj, language_id as li, names, piece_sampling as ps, substring_dedup as sd, token_store as ts
from speechloom.llm.workload import byte_tokenizer, piece_model


def twins(n=1024):
    """Two texts that share every polynomial hash modulo a power of two: a sequence by the parity of set bits, and its mirror."""
    parity = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[p] for p in parity), "".join("ba"[p] for p in parity)


@pytest.fixture(scope="module")
def twin_docs(spark):
    a, b = twins()
    return spark.createDataFrame([(1, a), (2, b), (3, a + " " + b), (4, b + " " + a)], "doc_id bigint, text string")


def test_the_twins_do_share_a_hash():
    import numpy as np

    a, b = (np.frombuffer(x.encode(), np.uint8) for x in twins())
    full = [batches.RangeHash(x).of(np.array([0]), np.array([len(x)]))[0] for x in (a, b)]
    assert full[0] == full[1]


def test_twins_are_not_linked(twin_docs):
    assert sorted(map(tuple, jj.near_duplicates(twin_docs).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4)]


def test_twins_keep_their_ids_and_pieces(spark, twin_docs):
    from tokenizers import Tokenizer

    import numpy as np

    library = Tokenizer.from_file(byte_tokenizer())
    texts = [r["text"] for r in twin_docs.orderBy("doc_id").collect()]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    ids, counts = ts.Encoder(byte_tokenizer()).encode(data, offsets)
    assert ids.tolist() == [i for t in texts for i in library.encode(t).ids]
    coded = ps.sampled_pieces(twin_docs, piece_model())
    assert all(r["lossless"] for r in coded.collect())
    assert {r["doc_id"]: r["text"] for r in ps.decoded_texts(coded, piece_model()).collect()} == dict(zip([1, 2, 3, 4], texts))


def test_twins_lose_only_what_they_share(twin_docs):
    texts = {r["doc_id"]: r["text"] for r in twin_docs.collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.substring_cuts(twin_docs).collect()}
    assert got == removal_truth(texts)


@pytest.mark.parametrize("bits", [1, 3])
def test_names_that_clash_are_given_anew(monkeypatch, spark, docs, bits):
    small = docs.where("doc_id % 3 = 0")
    near, cuts = (sorted(map(tuple, f(small).collect())) for f in (jj.near_duplicates, sd.substring_cuts))
    monkeypatch.setattr(names, "NAME_BITS", bits)
    assert sorted(map(tuple, jj.near_duplicates(small).collect())) == near
    assert sorted(map(tuple, sd.substring_cuts(small).collect())) == cuts


def test_declared_language_behind_a_long_opening():
    page = "<!DOCTYPE html>\n<?xml version='1.0'?>" + "<!-- " + "x" * 5000 + " -->" + " \n" * 20_000 + "<!-- y -->" * 5000 + "<HTML class=a LANG='De'>"
    assert li.declared_language(page) == "de"
    assert li.declared_language("<!-- " * 50_000) is None and li.declared_language(" " * 200_000) is None
    assert li.declared_language(None) is None and li.declared_language("<p><html lang=de>") is None


def test_columns_that_meet_inner_names(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs away from it at once "
    rows = [(i, f"{i} {passage * 2} {i}", "s", 7, 8, 9, 10, 11) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _left int, copy int, shuffle_key int, row int, `a.b` int")
    for stage in (corpus_pipeline.cut_repeats, corpus_pipeline.mix_sources, corpus_pipeline.drop_near_copies, corpus_pipeline.keep_good):
        got = stage(spark, df, "")
        assert got.columns == df.columns
        assert all((r["_left"], r["copy"], r["shuffle_key"], r["row"], r["a.b"]) == (7, 8, 9, 10, 11) for r in got.collect())


def test_stages_of_odd_rows(spark, docs, no_docs):
    odd = docs.union(docs.where("doc_id % 5 = 0")).union(docs.where("doc_id % 50 = 0").withColumn("doc_id", F.lit(None).cast("bigint")))
    kept = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, no_docs, "").collect() == []
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns and kept.count() > 0
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, "").collect() == []
    coded = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    assert coded.count() == kept.count() and coded.where("not lossless").isEmpty()


def test_only_results_stay_in_the_shared_folder(spark, docs):
    jj.near_duplicates(docs.limit(1)).count()
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    for operator in (jj.near_duplicates, sd.substring_cuts, jj.first_of_each, sd.cut_texts):
        before = set(os.listdir(folder))
        assert operator(docs).count() > 0
        assert len(set(os.listdir(folder)) - before) == 1


def test_no_key_gets_a_block_of_every_task(spark, docs):
    """What a task has found shared is never grouped with that of other tasks."""
    narrow = docs.union(docs).select(F.col("doc_id"), F.col("text").alias("_text")).repartition(20)
    for blocks in (jj.signature_blocks(narrow, 4, {}), sd.anchor_blocks(narrow, 4, {})):
        most = blocks.where("bucket < 0").groupBy("bucket").count().agg(F.max("count")).first()[0]
        assert most == 1


def test_store_is_read_by_its_folder_alone(spark, docs, tmp_path):
    ts.write_store(docs, byte_tokenizer(), f"{tmp_path}/store")
    got = {r["doc_id"]: r["n_tokens"] for r in ts.read_store(spark.newSession(), f"{tmp_path}/store").collect()}
    assert got == {r["doc_id"]: r["n_tokens"] for r in ts.stored(docs, byte_tokenizer()).collect()} and len(got) == docs.count()
    with pytest.raises(Exception):
        ts.read_store(spark, f"{tmp_path}/nothing")


def test_cost_of_a_rule_is_its_own(spark, docs):
    """Of two rules that reject the same rows the cheap one goes first, however short the sample."""
    from speechloom.llm import quality_rules as qr

    dear = F.size(F.filter("_words", lambda w: F.length(F.sha2(F.concat(w, w), 512)) > 0)) > 40
    pair = (qr.Rule("a_dear", dear), qr.Rule("b_cheap", F.size("_words") > 40))
    for _ in range(3):
        assert [r.name for r in qr.ordered(docs.select("text"), pair)] == ["b_cheap", "a_dear"]


def test_an_address_repeated_often_is_one_row(spark):
    from speechloom.llm import url_filter as uf

    rows = [(i, "https://x.org/about" if i % 3 else f"https://y{i}.com/de/a") for i in range(3000)] + [(9000, None), (None, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = uf.judged_urls(pages).collect()
    assert len(got) == len(rows) and {r["verdict"] for r in got if r["rule"] == "org/"} == {"allow"}
