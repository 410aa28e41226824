"""Streaming ingestion, and per-series state.

Late rows are never dropped on the way in: retention is relative to each series' own newest timestamp and
is applied when reading. Spark's ``withWatermark`` is one mark for the whole query, so it isn't used.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.downsample import bucket
from tidemark.sources.store import Store


def ingest(store: Store, stream: DataFrame, checkpoint: str, name: str = "ingest", **trigger: Any) -> StreamingQuery:
    """Appends each micro-batch as one commit of the store.

    The batch's number goes into the manifest with the data, so a batch that runs again after a crash
    changes nothing. ``maxFilesPerTrigger`` and the like on the source bound a batch. Within a batch
    ``op_idx`` orders operations on one key.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        store.write(batch, token=f"{name}@{batch_id}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def series_watermarks(stream: DataFrame) -> DataFrame:
    """A row ``measurement, latest_timestamp`` whenever a series' mark rises; marks never fall."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        newest = max([int(pdf.timestamp.max()) for pdf in batches] + ([before] if before is not None else []))
        state.update((newest,))
        if newest != before:
            yield pd.DataFrame({"measurement": [key[0]], "latest_timestamp": [newest]})

    highest = stream.select("measurement", "timestamp")
    out = "measurement string, latest_timestamp long"
    return highest.groupBy("measurement").applyInPandasWithState(advance, out, "latest_timestamp long", "update", GroupStateTimeout.NoTimeout)


def downsample(stream: DataFrame, t_start: int, interval_ns: int) -> DataFrame:
    """Running sums for each series and window; the state has a row for each window, not for each point."""
    value = F.col("value").cast("decimal(18,4)")
    groups = stream.groupBy("measurement", bucket(t_start, interval_ns).alias("bucket"))
    return groups.agg(F.sum(value).alias("total"), F.count("*").alias("n"))
