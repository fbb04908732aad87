"""Progress of running jobs as a stream: the incremental form of the monotone progress report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from speechloom.operators.progress import step_percent


def monotone_progress_stream(events: DataFrame) -> DataFrame:
    """Reports exceeding all earlier ones of their recording, from a stream of step counters.

    ``events``: ``recording_id, seq, step, completed, total``. The state of a recording is its highest percent so
    far; it is given up when 100 is reached. Within a micro-batch, rows count in the order of ``seq``. A row with step
    ``done`` reports 100; events of that recording in later micro-batches begin a new report.
    """
    rated = events.select("recording_id", "seq", F.when(F.col("step") == "done", 100.0).otherwise(
        step_percent(F.col("step"), F.col("completed"), F.col("total"))).alias("percent")).filter(
        F.col("percent") > 0)
    kind = events.schema["recording_id"].dataType.simpleString()

    def raise_only(key, chunks, state: GroupState):
        top = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(chunks)).sort_values("seq", kind="stable", ignore_index=True)
        reached = rows["percent"].cummax().shift(fill_value=0.0).clip(lower=top)
        best = max(top, float(rows["percent"].max()))
        if best < 100.0:
            state.update((best,))
        elif state.exists:
            state.remove()
        yield rows[rows["percent"] > reached][["recording_id", "seq", "percent"]]

    return rated.groupBy("recording_id").applyInPandasWithState(
        raise_only, f"recording_id {kind}, seq bigint, percent double", "top double", "append",
        GroupStateTimeout.NoTimeout)
