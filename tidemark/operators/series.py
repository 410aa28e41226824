"""Running values along a series, without one task for each series.

A series is cut into blocks. A window within each block, and one over the blocks' totals, which are few, give what a
window over the series would; a join brings the two together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nanoseconds in a block of time.
BLOCK_NS = 86_400_000_000_000


def time_block(block_ns: int = BLOCK_NS) -> Column:
    t = F.col("timestamp")
    return t - F.pmod(t, F.lit(block_ns))


def running_sum(df: DataFrame, value: Column, order: list[str], block: Column, into: str, key: str = "measurement") -> DataFrame:
    """The frame with ``into``, the sum of ``value`` up to and with each row; ``block`` rises with ``order``."""
    rows = df.withColumn("_block", block).withColumn("_value", value)
    inside = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "_block").agg(F.sum("_value").alias("_total")).select(key, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return rows.withColumn(into, F.sum("_value").over(inside)).join(totals, [key, "_block"]).withColumn(into, F.col(into) + F.col("_before")).drop("_block", "_value", "_before")


def before(df: DataFrame, block: Column | None = None) -> DataFrame:
    """``measurement, timestamp`` with the two timestamps before, ``_p`` and ``_pp``; NULL where there are none."""
    rows = df.withColumn("_block", time_block() if block is None else block)
    inside = Window.partitionBy("measurement", "_block").orderBy("timestamp")
    rows = rows.withColumn("_p", F.lag("timestamp").over(inside)).withColumn("_pp", F.lag("timestamp", 2).over(inside))
    ends = rows.groupBy("measurement", "_block").agg(F.max("timestamp").alias("_last"), F.max_by("_p", "timestamp").alias("_next_to_last"))
    blocks = Window.partitionBy("measurement").orderBy("_block")
    ends = ends.withColumn("_next_to_last", F.coalesce("_next_to_last", F.lag("_last").over(blocks)))
    ends = ends.select("measurement", "_block", F.lag("_last").over(blocks).alias("_q"), F.lag("_next_to_last").over(blocks).alias("_qq"))
    pp = F.when(F.col("_p").isNull(), F.col("_qq")).otherwise(F.coalesce("_pp", "_q"))
    return rows.join(ends, ["measurement", "_block"]).withColumn("_pp", pp).withColumn("_p", F.coalesce("_p", "_q")).drop("_block", "_q", "_qq")
