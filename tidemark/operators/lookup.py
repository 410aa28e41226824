"""Point reads. One key is a filter; many keys are a join, never a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get(points: DataFrame, measurement: str, timestamp: int) -> DataFrame:
    """No row or one row."""
    return points.where((F.col("measurement") == measurement) & (F.col("timestamp") == timestamp))


def multi_get(points: DataFrame, keys: DataFrame) -> DataFrame:
    """Each distinct key with its value, NULL where there is none."""
    wanted = keys.select("measurement", "timestamp").distinct()
    return wanted.join(points, ["measurement", "timestamp"], "left").select("measurement", "timestamp", "value")


def of_keys(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """The operations on some keys, before their versions are resolved: what isn't asked for isn't shuffled twice."""
    return ops.join(keys.select("measurement", "timestamp").distinct(), ["measurement", "timestamp"], "left_semi")


def missing(points: DataFrame, keys: DataFrame) -> DataFrame:
    """The distinct keys that have no live point."""
    return keys.select("measurement", "timestamp").distinct().join(points, ["measurement", "timestamp"], "left_anti")
