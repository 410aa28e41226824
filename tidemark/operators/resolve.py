"""From the operation log to live points.

The order is fixed: clamp keys, resolve the newest version of each key, drop tombstones, apply retention.
Tombstones take part in the resolution; filtering them first would bring older values back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import NS

KEY = ("measurement", "timestamp")


def latest(ops: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones included.

    ``row_number() = 1`` becomes a WindowGroupLimit on both sides of the exchange, so a key with very
    many versions shrinks before the shuffle, and key predicates reach the scan through the window.
    """
    newest = Window.partitionBy(*KEY).orderBy(F.col("seq").desc())
    return ops.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def live(ops: DataFrame) -> DataFrame:
    """Newest versions that aren't tombstones: ``measurement, timestamp, value``."""
    return latest(ops).where(~F.col("deleted")).select("measurement", "timestamp", "value")


def watermarks(ops: DataFrame) -> DataFrame:
    """``measurement, latest_timestamp`` over all operations: deletes advance it too."""
    return ops.groupBy("measurement").agg(F.max("timestamp").alias("latest_timestamp"))


def horizons(rules: DataFrame, marks: DataFrame) -> DataFrame:
    """``measurement, horizon``: the oldest timestamp that each rule keeps. Rules of 0 s or less are off."""
    on = rules.where(F.col("ttl_seconds") > 0)
    return on.join(marks, "measurement").select("measurement", (F.col("latest_timestamp") - F.col("ttl_seconds") * F.lit(NS)).alias("horizon"))


def unexpired(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows at or after their series' horizon; series without one are kept whole.

    The marks come from a separate aggregate and a join, not from a window over the data: a window over
    the series would stop the time predicate above it. AQE broadcasts the limits when they are small.
    """
    joined = df.join(limits, "measurement", "left")
    return joined.where(F.col("horizon").isNull() | (F.col("timestamp") >= F.col("horizon"))).drop("horizon")


def in_range(df: DataFrame, measurement: str | None, t_start: int, t_end: int) -> DataFrame:
    """Inclusive at both ends; empty when reversed. ``None`` means every series."""
    rows = df.where(F.col("timestamp").between(t_start, t_end))
    return rows if measurement is None else rows.where(F.col("measurement") == measurement)


def key_between(begin: tuple[str, int], end: tuple[str, int]) -> Column:
    """``begin <= (measurement, timestamp) <= end``, written out so that Parquet gets the bounds on measurement."""
    m, t = F.col("measurement"), F.col("timestamp")
    low = (m > begin[0]) | ((m == begin[0]) & (t >= begin[1]))
    high = (m < end[0]) | ((m == end[0]) & (t <= end[1]))
    return m.between(begin[0], end[0]) & low & high
