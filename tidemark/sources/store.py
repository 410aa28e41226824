"""A store: immutable sorted Parquet segments, and versions that name the live ones.

Layout: ``data/<segment>/part-*.parquet`` and ``manifest/<version>.json``. A version is written under
another name and renamed, so a crash leaves either the old version or the new one, never a part of a
batch. A reader pins the version it has loaded: what a newer one no longer names is deleted ``retain_s`` after it
was superseded, by whoever cleans up. One writer at a time; a second one gets ConflictError. Without any manifest
the complete segments found are the store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import CorruptionError, InvalidArgumentError
from tidemark.operators import downsample as ds
from tidemark.operators import lookup, resolve
from tidemark.operators.batch import WriteBatch
from tidemark.schema import MANIFEST, OP_LOG, SEQ_SHIFT, TTL_RULES

LEVELS = 7


def _key() -> Column:
    return F.struct("measurement", "timestamp")


@dataclass(frozen=True)
class Options:
    #: Segments of level 0 that trigger a compaction.
    level0_segments: int = 4
    #: Bytes that level 1 may hold; each further level twice as many.
    level_bytes: int = 1 << 30
    #: Rows in one Parquet file at most.
    max_records_per_file: int = 8_000_000
    #: Bytes of one file of a compaction at most, by the mean row of its inputs.
    file_bytes: int = 256 << 20
    #: Bloom filters on the series and the timestamps of each file.
    bloom: bool = True
    #: Seconds for which superseded segments, and segments that no version names, are kept.
    retain_s: float = 3600.0


@dataclass(frozen=True)
class Segment:
    number: int
    level: int
    name: str
    bytes: int
    smallest: list = field(default_factory=list)
    largest: list = field(default_factory=list)
    rows: int = 0


class Store:
    """``Store(spark, path)`` opens or creates; usable as a context manager."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None) -> None:
        from tidemark.sources.files import Files

        self.spark, self.path, self.options = spark, path, options or Options()
        self.files = Files(spark, path)
        self.files.mkdirs("data")
        self.files.mkdirs("manifest")
        self.candidates = self.probes = 0
        self.closed = self.wrote = False
        self.refresh()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_exc: object) -> None:
        self.close()

    # versions

    def versions(self) -> list[str]:
        return [n for n, _, _ in self.files.list("manifest") if n.endswith(".json")]

    def load(self, version: str) -> dict:
        try:
            return json.loads(self.files.read(f"manifest/{version}"))
        except ValueError as e:
            raise CorruptionError(f"manifest/{version}: {e}") from e

    def refresh(self) -> None:
        """Loads the newest version."""
        versions = self.versions()
        state = {"version": 0, "next_segment": 1, "next_commit": 1, "segments": [], "rules": {}, "batches": {}}
        self.state = state | (self.load(versions[-1]) if versions else self._discovered())
        self.segments = [Segment(**s) for s in self.state["segments"]]

    def _discovered(self) -> dict:
        """What the complete segments of a store that has lost its manifest say; its rules are lost."""
        found, commits = [], [0]
        for name, _, is_dir in self.files.list("data"):
            files = self.files.list(f"data/{name}") if is_dir else []
            if any(n == "_SUCCESS" for n, _, _ in files):
                low, high, last, n = self.read_segments([name]).agg(F.min(_key()), F.max(_key()), F.max("seq"), F.count("*")).first()
                if n:
                    found.append(vars(Segment(int(name.partition("-")[0]), 0, name, sum(b for f, b, _ in files if f.endswith(".parquet")), list(low), list(high), n)))
                    commits.append(last >> SEQ_SHIFT)
        return {"segments": found, "next_segment": max([0, *(s["number"] for s in found)]) + 1, "next_commit": max(commits) + 1}

    def commit(self, **changes: object) -> None:
        """Publishes the next version, or raises ConflictError and leaves the store as it was."""
        new = self.state | changes
        new["version"] = self.state["version"] + 1
        new["segments"] = [vars(s) if isinstance(s, Segment) else s for s in new["segments"]]
        self.files.publish(f"manifest/{new['version']:020d}.json", json.dumps(new))
        self.state, self.segments, self.wrote = new, [Segment(**s) for s in new["segments"]], True

    def manifest(self) -> DataFrame:
        """A row for each live segment."""
        rows = [(s.level, s.number, s.name, s.bytes, tuple(s.smallest) or None, tuple(s.largest) or None) for s in self.segments]
        return self.spark.createDataFrame(rows, MANIFEST)

    # writing

    def write_segment(self, ops: DataFrame, level: int, number: int, max_rows: int | None = None) -> Segment | None:
        """Writes rows of OP_LOG sorted by key; None when there are none.

        ``repartitionByRange`` samples the keys and gives files that overlap little; AQE doesn't merge
        them, so the number of partitions is the session's. Bounds and rows are observed on the way.
        """
        name = f"{number:06d}-{uuid.uuid4().hex[:12]}"
        seen = Observation()
        rows = ops.select(*OP_LOG.fieldNames()).repartitionByRange("measurement", "timestamp").sortWithinPartitions("measurement", "timestamp", F.col("seq").desc())
        rows = rows.observe(seen, F.min(_key()).alias("low"), F.max(_key()).alias("high"), F.count("*").alias("n"))
        writer = rows.write.option("maxRecordsPerFile", max_rows or self.options.max_records_per_file).option("parquet.page.write-checksum.enabled", "true")
        if self.options.bloom:
            writer = writer.option("parquet.bloom.filter.enabled#measurement", "true").option("parquet.bloom.filter.enabled#timestamp", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(self.files.full(f"data/{name}"))
        size = sum(b for n, b, _ in self.files.list(f"data/{name}") if n.endswith(".parquet"))
        got = seen.get
        if not got["n"]:
            self.files.delete(f"data/{name}")
            return None
        return Segment(number, level, name, size, list(got["low"]), list(got["high"]), got["n"])

    def write(self, batch: WriteBatch | DataFrame, token: str | None = None) -> int:
        """One commit for the whole batch; returns its number, or 0 for an empty batch.

        A DataFrame has ``measurement, timestamp, value, deleted`` and optionally ``op_idx``, which orders
        operations on one key and must be from 0 to 2**32 - 1, else the write fails; without it the keys must be distinct. A token that was committed before
        makes the call a no-op, so a restarted stream doesn't write twice.
        """
        self._open()
        source, _, tick = (token or "").rpartition("@")
        if token and int(tick) <= self.state["batches"].get(source, -1):
            return 0
        if isinstance(batch, WriteBatch):
            if batch.empty():
                return 0
            batch = batch.to_df(self.spark)
        op_idx = F.col("op_idx").cast("long") if "op_idx" in batch.columns else F.lit(0).cast("long")
        number, most = self.state["next_commit"], (1 << SEQ_SHIFT) - 1
        op_idx = F.when(op_idx.between(0, most), op_idx).otherwise(F.raise_error(F.lit(f"op_idx must be from 0 to {most}")).cast("long"))
        ops = batch.select(
            "measurement",
            F.col("timestamp").cast("long").alias("timestamp"),
            F.when(F.col("deleted"), F.lit("")).otherwise(F.col("value")).alias("value"),
            "deleted",
            (F.lit(number << SEQ_SHIFT) + op_idx).alias("seq"),
        )
        made = self.write_segment(ops, 0, self.state["next_segment"])
        changes: dict = {"segments": [*self.segments, *([made] if made else [])], "next_segment": self.state["next_segment"] + 1, "next_commit": number + 1}
        if token:
            changes["batches"] = self.state["batches"] | {source: int(tick)}
        if made or token:
            self.commit(**changes)
        return number if made else 0

    def put(self, measurement: str, timestamp: int, value: str) -> int:
        return self.write(WriteBatch().put(measurement, timestamp, value))

    def delete(self, measurement: str, timestamp: int) -> int:
        return self.write(WriteBatch().delete(measurement, timestamp))

    def flush(self) -> None:
        """Nothing is held back: each write is durable when it returns."""
        self._open()

    def set_ttl(self, measurement: str, seconds: int) -> None:
        """Persisted; 0 or less removes the rule."""
        self._open()
        rules = {k: v for k, v in self.state["rules"].items() if k != measurement}
        self.commit(rules=rules | ({measurement: int(seconds)} if seconds > 0 else {}))

    # reading

    def read_segments(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], OP_LOG)
        return self.spark.read.schema(OP_LOG).option("parquet.page.verify-checksum.enabled", "true").parquet(*(self.files.full(f"data/{n}") for n in names))

    def ops(self, low: tuple[str, int] | None = None, high: tuple[str, int] | None = None) -> DataFrame:
        """All versions of all keys, or those in segments that can hold a key between the bounds."""
        hit = [s for s in self.segments if low is None or high is None or not (tuple(s.largest) < low or tuple(s.smallest) > high)]
        self.candidates += len(self.segments)
        self.probes += len(hit)
        return self.read_segments([s.name for s in hit])

    def ttl_rules(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.state["rules"].items()), TTL_RULES)

    def horizons(self, measurement: str | None = None) -> DataFrame | None:
        """The marks come from every operation of the series with rules, or of the one asked for; None without rules."""
        rules = [m for m in self.state["rules"] if measurement in (None, m)]
        if not rules:
            return None
        hit = [s.name for s in self.segments if any(s.smallest[0] <= m <= s.largest[0] for m in rules)]
        marks = resolve.watermarks(self.read_segments(hit).where(F.col("measurement").isin(rules)))
        return resolve.horizons(self.ttl_rules(), marks)

    def _live(self, ops: DataFrame, measurement: str | None = None) -> DataFrame:
        points, limits = resolve.live(ops), self.horizons(measurement)
        return points if limits is None else resolve.unexpired(points, limits)

    def points(self) -> DataFrame:
        """The live points of the whole store."""
        return self._live(self.ops())

    def get(self, measurement: str, timestamp: int) -> DataFrame:
        key = (measurement, timestamp)
        return self._live(lookup.get(self.ops(key, key), measurement, timestamp), measurement)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        wanted = keys.select("measurement", "timestamp").distinct()
        return lookup.multi_get(self._live(self.ops().join(wanted, ["measurement", "timestamp"], "left_semi")), wanted)

    def range_query(self, measurement: str, t_start: int, t_end: int) -> DataFrame:
        rows = self.ops((measurement, t_start), (measurement, t_end))
        return self._live(resolve.in_range(rows, measurement, t_start, t_end), measurement).orderBy("timestamp")

    def key_range_scan(self, begin: tuple[str, int], end: tuple[str, int], raw: bool = False) -> DataFrame:
        """In key order; ``raw`` gives the newest versions with their tombstones, expired ones too."""
        rows = self.ops(begin, end).where(resolve.key_between(begin, end))
        return (resolve.latest(rows) if raw else self._live(rows)).orderBy("measurement", "timestamp")

    def downsample(self, measurement: str | None, t_start: int, t_end: int, interval_ns: int, agg: str = "avg", on_bad: str = "raise") -> DataFrame:
        rows = self.ops() if measurement is None else self.ops((measurement, t_start), (measurement, t_end))
        points = self._live(resolve.in_range(rows, measurement, t_start, t_end), measurement)
        return ds.downsample(points, measurement, t_start, t_end, interval_ns, agg, on_bad).orderBy("measurement", "timestamp")

    def count(self) -> int:
        """Versions of keys, those that newer ones hide too."""
        return sum(s.rows for s in self.segments)

    def empty(self) -> bool:
        return not self.segments

    def replay(self) -> DataFrame:
        """Every operation in the order of the writes, deletes too."""
        return self.ops().orderBy("seq")

    def visit(self, visitor: Callable[[str, int, str], bool | None]) -> int:
        """Calls the visitor with each live point in key order until it returns False; how many it was called with.

        For clients: one partition at a time comes to the driver. Jobs take ``points()``.
        """
        seen = 0
        for row in self.points().orderBy("measurement", "timestamp").toLocalIterator():
            seen += 1
            if visitor(*row) is False:
                break
        return seen

    # maintenance and state

    def compact(self, cleanup: bool = True) -> bool:
        from tidemark.sources import maintain

        return maintain.compact(self, cleanup=cleanup)

    def cleanup_obsolete(self, retain_s: float | None = None) -> list[str]:
        from tidemark.sources import maintain

        return maintain.vacuum(self, retain_s)

    def stats(self) -> DataFrame:
        from tidemark.sources import maintain

        return maintain.stats(self)

    def reset_read_stats(self) -> None:
        self.candidates = self.probes = 0

    def mem_usage(self) -> int:
        """Nothing is buffered outside Spark's jobs."""
        return 0

    def close(self) -> None:
        """Idempotent. A handle that has written cleans up what is older than ``retain_s``; a reader deletes nothing."""
        if not self.closed:
            if self.wrote:
                self.cleanup_obsolete()
            self.closed = True

    def _open(self) -> None:
        if self.closed:
            raise InvalidArgumentError("the store is closed")
