"""Recordings from files, and what their names and samples become."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from speechloom.sources import recordings as rc


def test_names_of_recordings(spark):
    paths = ["file:/a/b.c/talk.one.wav", "talk", "/x/.hidden", "s3://bucket/y/.hidden.mp3", "a.b.", "/d/é ü.flac"]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(rc.recording_id(F.col("p"))).collect()]
    assert got == ["talk.one", "talk", ".hidden", ".hidden", "a.b", "é ü"]


def test_files_become_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, samples in (("one.pcm", [0, 16384, -32768]), ("in/two.pcm", [5]), ("none.pcm", [])):
        (tmp_path / name).write_bytes(struct.pack(f"<{len(samples)}h", *samples))
    rows = {r.recording_id: r for r in rc.read_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"one", "two"} and rows["one"].path.endswith("/one.pcm")
    assert bytes(rows["one"].content) == struct.pack("<3h", 0, 16384, -32768) and bytes(rows["two"].content) == struct.pack("<h", 5)


def test_tables_by_recording(spark, tmp_path):
    """One file per recording; the name is the key, and other columns are still pruned."""
    for name, n in (("first", 3), ("second.take", 2)):
        spark.range(n).withColumn("x", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "w" / name))
        part = next((tmp_path / "w" / name).glob("part-*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        part.rename(tmp_path / "all" / f"{name}.parquet")
    df = rc.read_parquet(spark, str(tmp_path / "all"))
    assert {(r.recording_id, r["count"]) for r in df.groupBy("recording_id").count().collect()} == {("first", 3), ("second.take", 2)}
    assert "x:" not in df.select("recording_id", "id")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_samples_are_scaled(spark):
    df = spark.createDataFrame([([0, 16384, -32768, 32767],)], "s array<smallint>")
    assert df.select(rc.scale_pcm(F.col("s"))).first()[0] == [0.0, 0.5, -1.0, 32767 / 32768]
