"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from speechloom.plans.blocks import checkpointed, inner_tables


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each node of ``edges`` (``a, b``) reaches, for all nodes that reach a smaller one.

    Alternates two contractions: every node hangs its larger neighbours, then its smaller ones, on the smallest. The number
    of edges never grows and the number of rounds is logarithmic in the longest path. Each round is written to the
    shared folder, so a lost executor repeats no earlier round; only two numbers per round reach the driver.
    """
    with inner_tables(edges.sparkSession) as kept:
        now = checkpointed(edges.where("a <> b").select(
            F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
        print_ = _print(now)
        while True:
            both = now.union(now.select("y", "x")).toDF("x", "y")
            least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
            larger = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
            least = larger.groupBy("x").agg(F.min("y").alias("m"))
            hung = larger.join(least, "x")
            now = checkpointed(
                hung.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
                .union(least.select("x", F.col("m").alias("y"))).distinct())
            after = _print(now)
            if after == print_:
                return kept(now.select(F.col("x").alias("node"), F.col("y").alias("component")))
            print_ = after


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first())
