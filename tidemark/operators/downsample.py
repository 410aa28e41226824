"""Aggregation into windows that are anchored at the start of the query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgumentError
from tidemark.operators.resolve import in_range

AGGREGATES = ("avg", "max", "min", "last")


def number(on_bad: str = "raise") -> Column:
    """The value as DOUBLE. Text that isn't a number raises, or with ``on_bad="null"`` is left out."""
    if on_bad not in ("raise", "null"):
        raise InvalidArgumentError(f"on_bad must be raise or null: {on_bad}")
    value = F.col("value")
    return value.cast("double") if on_bad == "raise" else value.try_cast("double")


def bucket(t_start: int, interval_ns: int) -> Column:
    """Start of the half-open window that holds the timestamp."""
    shifted = F.col("timestamp") - F.lit(t_start)
    return F.lit(t_start) + (shifted - F.pmod(shifted, F.lit(interval_ns)))


def downsample(points: DataFrame, measurement: str | None, t_start: int, t_end: int, interval_ns: int, agg: str = "avg", on_bad: str = "raise") -> DataFrame:
    """``measurement, timestamp`` (of the window's start), and ``value_num``; for ``last`` the text ``value`` instead.

    Empty windows give no row. A width of 0 or less, or a reversed range, gives no rows. ``last`` never
    parses. NaN counts as the largest value. The cost follows the rows, not the windows.
    """
    if agg not in AGGREGATES:
        raise InvalidArgumentError(f"unknown aggregate: {agg}")
    rows = in_range(points, measurement, t_start, t_end)
    if interval_ns <= 0 or t_end < t_start:
        rows, interval_ns = rows.where(F.lit(False)), 1
    groups = rows.withColumn("_bucket", bucket(t_start, interval_ns)).groupBy("measurement", F.col("_bucket").alias("timestamp"))
    if agg == "last":
        return groups.agg(F.max_by("value", rows["timestamp"]).alias("value"))
    of = {"avg": F.avg, "max": F.max, "min": F.min}[agg](number(on_bad))
    return groups.agg(of.alias("value_num")).where(F.col("value_num").isNotNull())


def as_text(df: DataFrame) -> DataFrame:
    """``value_num`` printed with six decimals, as ``value``."""
    return df.withColumn("value", F.format_string("%.6f", "value_num")).drop("value_num")
