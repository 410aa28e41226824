"""Connected components of a graph that needn't fit on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours are linked to the least of them and itself.

    ``larger``: the larger neighbours of every node; else the smaller ones, and the node.
    """
    near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = near.join(least, "a")
    out = linked.where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b") if larger else linked.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where("a < b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``node, root`` from pairs ``a, b`` of longs: the least node that each can reach. Nodes without a pair have no row.

    Large-star and small-star steps alternate until they change nothing; each round is written to the shared
    folder, and two numbers come to the driver. The joins' larger side is split by AQE when a node is a hub.
    """
    now = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        now = written(_star(_star(now, True), False), "links")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
