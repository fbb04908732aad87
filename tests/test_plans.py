"""Physical plans: no pair enumeration, shared shuffles, row-local work without shuffles."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from speechloom.operators import words as wd
from speechloom.workload import catalog

SF_DIR = "/root/testdata/sf0.001"
# Queries whose plans are built without running other jobs first.
LAZY = sorted(set(catalog.QUERIES) - {
    "min_cut", "pack_chunks", "cues_limited", "align_corpus", "speech_chunks"})


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pair_enumeration(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hysteresis_reads_frames_once(spark):
    df = entry.queries()["hysteresis"](spark, SF_DIR)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and final.count("ReusedExchange") >= 1
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in (
        df._jdf.queryExecution().explainString(
            df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))


def test_roll_ups_stay_on_their_row(spark):
    rows = [(1, 0, "ab c. d", [(0, 5, 0.5)] * 7)]
    table = spark.createDataFrame(
        rows, f"recording_id bigint, segment_idx bigint, text string, times array<{wd.TIME}>")
    for df in (wd.word_rollup(wd.timed_sentences(table)), wd.sentence_rollup(wd.timed_sentences(table)), wd.spans(table)):
        assert "Exchange" not in plan_of(df)


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF_DIR}/events.parquet").withColumnRenamed("user_id", "recording_id").withColumnRenamed(
        "event_id", "sample_idx")
    from speechloom.operators import signal as sg

    plan = plan_of(sg.head(df.select("recording_id", "sample_idx", "value"), 10))
    assert "LessThan(event_id,10)" in plan
    assert "props" not in plan
