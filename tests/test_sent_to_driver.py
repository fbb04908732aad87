"""Rows written out from a text are not sent through the driver."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


def broadcast_generates(df) -> int:
    """Explodes below a broadcast of the plan: Spark takes their rows for as small as the rows they come from."""
    found, inside = 0, None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = re.search(r"[A-Za-z]", line)
        if depth is None:
            continue
        if inside is not None and depth.start() <= inside:
            inside = None
        if inside is None and "BroadcastExchange" in line:
            inside = depth.start()
        found += inside is not None and "Generate " in line
    return found


@pytest.mark.parametrize("name", ["char_sentence", "frame_to_time"])
def test_written_out_rows_are_not_broadcast(spark, name):
    assert broadcast_generates(entry.queries()[name](spark, SF_DIR)) == 0


def test_filling_does_not_read_the_rest_of_a_segment_for_every_word(spark):
    plan = entry.queries()["interp_nearest"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan


def test_words_take_few_passes_over_their_characters(spark):
    """Functions called for every character are interpreted and cost most of a roll-up."""
    plan = entry.queries()["word_rollup"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(") <= 14
