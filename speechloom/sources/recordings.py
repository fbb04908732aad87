"""Reading many recordings at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PCM_SCALE = 32768.0


def recording_id(path: Column) -> Column:
    """Base name of a path without its last extension; a leading dot is part of the name."""
    name = F.regexp_replace(path, r"^.*/", "")
    return F.regexp_replace(name, r"([^.])\.[^.]*$", "$1")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``recording_id, path, content``: one row per file below the path; an empty file holds no recording and gives none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(recording_id(F.col("path")).alias("recording_id"), "path", "content")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A table stored as one file per recording, with ``recording_id`` taken from the file name."""
    return spark.read.parquet(path).withColumn("recording_id", recording_id(F.col("_metadata.file_path")))


def scale_pcm(samples: Column) -> Column:
    """16-bit samples to floats in [-1, 1)."""
    return F.transform(samples, lambda x: (x / PCM_SCALE).cast("float"))
