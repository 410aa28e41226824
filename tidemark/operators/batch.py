"""An ordered batch of puts and deletes: one commit, later operations win."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tidemark.schema import BATCH


class WriteBatch:
    """Collects operations of one client; bulk loads pass a DataFrame to ``Store.write`` instead."""

    def __init__(self) -> None:
        self._ops: list[tuple[str, int, str, bool]] = []

    def put(self, measurement: str, timestamp: int, value: str) -> WriteBatch:
        self._ops.append((measurement, timestamp, value, False))
        return self

    def delete(self, measurement: str, timestamp: int) -> WriteBatch:
        self._ops.append((measurement, timestamp, "", True))
        return self

    def clear(self) -> None:
        self._ops.clear()

    def count(self) -> int:
        return len(self._ops)

    def empty(self) -> bool:
        return not self._ops

    def operations(self) -> Iterable[tuple[str, int, str, bool]]:
        return tuple(self._ops)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """Columns ``measurement, timestamp, value, deleted, op_idx``."""
        return spark.createDataFrame([(*op, i) for i, op in enumerate(self._ops)], BATCH)
