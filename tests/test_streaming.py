from __future__ import annotations

from speechloom.streaming.progress import monotone_progress_stream

EVENTS = "recording_id bigint, seq bigint, step string, completed bigint, total bigint"


def test_progress_rises_across_micro_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    batches = [
        [(1, 1, "segmentation", 1, 2), (1, 2, "segmentation", 1, 4), (2, 1, "embeddings", 1, 1)],
        [(1, 3, "segmentation", 1, 2), (1, 4, "embeddings", 0, 5), (1, 5, "done", 0, 0)],
        [(1, 6, "segmentation", 1, 4), (2, 2, "segmentation", 1, 2)],
    ]
    spark.createDataFrame(batches[0], EVENTS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENTS).parquet(source)
    query = (monotone_progress_stream(stream).writeStream.outputMode("append").format("memory").queryName("progress")
             .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    try:
        query.processAllAvailable()
        for rows in batches[1:]:
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
    finally:
        query.stop()
    got = sorted((r.recording_id, r.seq, r.percent) for r in spark.table("progress").collect())
    # The state of recording 1 ended with its report of 100; that of recording 2 still holds.
    assert got == [(1, 1, 25.0), (1, 4, 50.0), (1, 5, 100.0), (1, 6, 12.5), (2, 1, 99.0)]
