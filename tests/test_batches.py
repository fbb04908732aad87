"""Work done in batches: bounded ones for models, one pass for model and search, numbers of many rows at a time."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from speechloom.operators import alignment as al
from speechloom.sources import corpus
from speechloom.workload import alignment_queries as aq

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_models_get_pieces_of_a_batch(spark):
    def model(batches):
        for batch in batches:
            chars = int(batch["text"].str.len().fillna(0).sum())
            yield batch.assign(n_frames=chars, n_classes=1, logits=[np.zeros(1, np.float32)] * len(batch))

    rows = spark.range(60).select(
        F.lit(1).cast("bigint").alias("recording_id"), F.col("id").alias("segment_idx"),
        F.when(F.col("id") != 7, F.repeat(F.lit("x"), 10_000)).alias("text"))
    got = al.emit_with(rows, model).collect()
    assert sorted(r.segment_idx for r in got) == list(range(60))
    assert max(r.n_frames for r in got) <= al.MODEL_CHARS + 10_000


def test_paths_with_their_model_in_one_pass(spark):
    segments = al.with_tokens(aq.phrases(spark, SF_DIR).limit(200), aq.DICTIONARY).localCheckpoint()
    apart = al.align_paths(al.emit_with(segments, aq.ramps), log_probs=True)
    fused = al.align_paths(segments, log_probs=True, model=aq.ramps)
    assert sorted(fused.collect(), key=str) == sorted(apart.collect(), key=str)
    assert plan(entry.queries()["ctc_align"](spark, SF_DIR)).count("MapInPandas") == 1


@pytest.mark.parametrize("name", ["log_softmax", "wildcard_score"])
def test_frames_need_no_function_called_for_every_class(spark, name):
    assert "lambdafunction" not in plan(entry.queries()[name](spark, SF_DIR))


def test_log_softmax_of_odd_frames(spark):
    rows = [(0, [1.0, 2.0, 2.5]), (1, None), (2, []), (3, [1.0, None]), (4, [0.0, -math.inf])]
    table = spark.createDataFrame(rows, "k int, x array<float>").coalesce(1)
    got = {r.k: (r.y, r.w) for r in table.select("k", al.log_softmax(F.col("x")).alias("y"), al.wildcard_score(F.col("x"), 1).alias("w")).collect()}
    z = math.log(sum(math.exp(v) for v in rows[0][1]))
    assert got[0][0] == pytest.approx([v - z for v in rows[0][1]]) and got[0][1] == 2.5
    assert got[1] == (None, None) and got[2] == ([], None) and got[3] == ([None, None], 1.0) and got[4] == ([0.0, -math.inf], 0.0)


def test_cues_are_dealt_before_they_are_written_out(spark):
    written_out = plan(entry.queries()["vtt_highlight"](spark, SF_DIR)).split("Generate", 1)[1]
    assert "REPARTITION_BY_NUM" in re.split("SortMergeJoin|HashJoin", written_out)[0]


def test_ids_of_words_are_hashed_by_batch(spark):
    rows = [(0, "a  b a"), (1, None), (2, ""), (3, " é")]
    table = spark.createDataFrame(rows, "k int, text string").coalesce(1)
    want = F.transform(F.split("text", " ", -1), corpus.token_id)
    for r in table.select(corpus.word_ids("text").alias("got"), want.alias("want")).collect():
        assert r.got == r.want
    assert "lambdafunction" not in plan(corpus.token_rows(spark, SF_DIR))
