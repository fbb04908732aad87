"""Exact duplicates by the tree merge of digest runs, against plain grouping."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechloom.llm import digests
from speechloom.llm.grouped import with_group_values

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """Sorted (doc_id, keep_id, group_size, kept, sha) of (doc_id, text) rows."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(_LOWER)].append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha, stays = hashlib.sha256(text.encode()).hexdigest(), False
        for i in sorted(ids, key=lambda i: (i is not None, i)):
            out.append((i, keep, len(ids), not stays and i == keep, sha))
            stays = stays or i == keep
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize(("run_rows", "fan_bits"), [(16_384, 4), (4, 1), (7, 2), (1, 3)])
def test_groups_of_documents(spark, texts, docs, run_rows, fan_bits):
    got = digests.exact_duplicates(docs, run_rows=run_rows, fan_bits=fan_bits)
    assert rows_of(got) == brute(texts.items())


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, "a"), (None, "A"), (3, "a"), (3, "a"), (3, "A"), (1, None), (2, ""), (None, "alone"), (5, "É"), (6, "é"),
            (7, "x" * 300_000), (8, "X" * 300_000), (None, "n"), (None, "N"), *[(100 + i, "hot") for i in range(500)]]
    data = [(d, t, 1, "z", b"q", 2) for d, t in rows]
    df = spark.createDataFrame(data, "doc_id bigint, text string, keep_id int, digest string, row binary, _text int")
    for run_rows in (2, 16_384):
        assert rows_of(digests.exact_duplicates(df.repartition(7), run_rows=run_rows)) == brute(rows)


def test_empty_table(spark, no_docs):
    assert digests.exact_duplicates(no_docs).collect() == []


def test_rounds_keep_runs_sorted_and_apart(spark, docs):
    """After the rounds every holder has one run, sorted, and of its own digest range."""
    rows = digests.digested(docs, "doc_id", "text")
    runs = digests.first_runs(rows, 8).withColumn("holder", F.pmod(F.xxhash64("holder"), F.lit(8)))
    for done in range(3):
        runs = digests.exchanged(runs, 3, done, 1)
    got = runs.collect()
    assert len({r["holder"] for r in got}) == len(got) <= 8
    for r in got:
        e = np.frombuffer(bytes(r["run"]), digests.ENTRY)
        assert (np.diff(e["d0"].astype(object)) > 0).all() and (e["d0"] >> np.uint64(61) == r["holder"]).all()
    assert sum(r["n"] for r in got) == rows.select("digest").distinct().count()


def test_equal_digests_of_different_texts_stay_apart():
    """A run merges entries only if length and second checksum agree too."""
    e = np.zeros(3, digests.ENTRY)
    e["d0"], e["bytes"], e["check"], e["id"], e["known"], e["n"] = 5, [1, 1, 2], [9, 9, 9], [1, 2, 3], 1, 1
    out = digests.merged([e[2:], e[:2]])
    assert out["id"].tolist() == [2, 3] and out["n"].tolist() == [2, 1]


def test_hot_groups_are_broadcast_and_others_joined(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(3000)], "i int, k string")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    got = with_group_values(rows, groups, ["k"], "n").orderBy("i").collect()
    want = {r["k"]: (r["n"], r["top"]) for r in groups.collect()}
    assert len(got) == 3000 and all((r["n"], r["top"]) == want[r["k"]] for r in got)
