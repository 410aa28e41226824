"""The registered queries over the driver's tables, each with the SQL that gives the same rows.

``points`` has one series for each event type. ``oplog`` has one for each user with timestamps floored to
the day, so that keys collide; events of type ``error`` are tombstones, and ``event_id`` is the sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import downsample as ds
from tidemark.operators import lookup, resolve, series
from tidemark.operators.batch import WriteBatch
from tidemark.schema import TTL_RULES
from tidemark.sources import maintain

#: In ns.
DAY, HOUR = 86_400_000_000_000, 3_600_000_000_000
WEEK_S = 604_800

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# inputs


def nanos(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.concat(F.lit("ev."), "event_type").alias("measurement"), nanos(F.col("ts")).alias("timestamp"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("seq")
    )


def oplog(spark: SparkSession, sf_dir: str, value: Column | None = None) -> DataFrame:
    t = nanos(F.col("ts"))
    return events(spark, sf_dir).select(
        F.concat(F.lit("user."), F.col("user_id").cast("string")).alias("measurement"),
        (t - F.pmod(t, F.lit(DAY))).alias("timestamp"),
        F.when(F.col("event_type") == "error", F.lit("")).otherwise((F.col("value") if value is None else value).cast("string")).alias("value"),
        (F.col("event_type") == "error").alias("deleted"),
        F.col("event_id").alias("seq"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each part: larger than the events."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.lit("part."), F.col("l_partkey").cast("string")).alias("measurement"), nanos(F.col("l_shipdate")).alias("timestamp"), F.col("l_quantity").alias("value_num")
    )


POINTS = "SELECT 'ev.' || event_type AS measurement, CAST(epoch_us(ts) * 1000 AS BIGINT) AS timestamp, value AS value_num, CAST(value AS VARCHAR) AS value, event_id AS seq FROM events"
OPLOG = f"""SELECT 'user.' || CAST(user_id AS VARCHAR) AS measurement, CAST(epoch_us(ts) * 1000 - (epoch_us(ts) * 1000) % {DAY} AS BIGINT) AS timestamp,
  CASE WHEN event_type = 'error' THEN '' ELSE coalesce(props, '') END AS props, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value_num, event_type = 'error' AS deleted, event_id AS seq FROM events"""
LATEST = f"SELECT * FROM ({OPLOG}) QUALIFY row_number() OVER (PARTITION BY measurement, timestamp ORDER BY seq DESC) = 1"
LIVE = f"SELECT measurement, timestamp, value_num FROM ({LATEST}) WHERE NOT deleted"
MARKS = f"SELECT measurement, max(timestamp) AS latest_timestamp FROM ({OPLOG}) GROUP BY 1"


def as_number(df: DataFrame) -> DataFrame:
    """Text of doubles differs between engines, so results carry the number."""
    return df.withColumn("value_num", F.when(F.col("value") != "", F.col("value")).cast("double")).drop("value")


# resolution, reads


@query(f"SELECT measurement, timestamp, value_num, deleted, seq FROM ({LATEST})")
def lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_number(resolve.latest(oplog(spark, sf_dir))).select("measurement", "timestamp", "value_num", "deleted", "seq")


@query(LIVE)
def live_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_number(resolve.live(oplog(spark, sf_dir)))


def _rules(spark: SparkSession, rules: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(rules, TTL_RULES)


@query(f"SELECT p.* FROM ({LIVE}) p JOIN ({MARKS}) m USING (measurement) WHERE p.timestamp >= m.latest_timestamp - {WEEK_S} * 1000000000::BIGINT")
def ttl_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = oplog(spark, sf_dir)
    marks = resolve.watermarks(ops)
    rules = marks.select("measurement", F.lit(WEEK_S).cast("long").alias("ttl_seconds"))
    return as_number(resolve.unexpired(resolve.live(ops), resolve.horizons(rules, marks)))


RULES = [("user.1", 86_400), ("user.2", 10 * 86_400), ("user.3", 0), ("user.nobody", 5)]


@query(
    f"""SELECT p.* FROM ({LIVE}) p LEFT JOIN (VALUES ('user.1', 86400::BIGINT), ('user.2', 864000), ('user.3', 0), ('user.nobody', 5)) r(measurement, ttl) USING (measurement)
  LEFT JOIN ({MARKS}) m USING (measurement) WHERE r.ttl IS NULL OR r.ttl <= 0 OR p.timestamp >= m.latest_timestamp - r.ttl * 1000000000"""
)
def ttl_multi_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = oplog(spark, sf_dir)
    return as_number(resolve.unexpired(resolve.live(ops), resolve.horizons(_rules(spark, RULES), resolve.watermarks(ops))))


@query(MARKS)
def series_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.watermarks(oplog(spark, sf_dir))


#: 10 days from 2024-01-05.
FROM, TO = 1_704_412_800_000_000_000, 1_705_276_800_000_000_000


@query(f"SELECT * FROM ({LIVE}) WHERE measurement = 'user.7' AND timestamp BETWEEN {FROM} AND {TO}")
def range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_number(resolve.live(resolve.in_range(oplog(spark, sf_dir), "user.7", FROM, TO))).orderBy("timestamp")


@query(f"SELECT * FROM ({LIVE}) WHERE false")
def range_query_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_number(resolve.live(resolve.in_range(oplog(spark, sf_dir), "user.7", TO, FROM)))


@query(f"SELECT * FROM ({LIVE}) WHERE measurement = 'user.7' AND timestamp = (SELECT max(timestamp) FROM ({LIVE}) WHERE measurement = 'user.7')")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest live point of one series."""
    rows = as_number(resolve.live(oplog(spark, sf_dir).where("measurement = 'user.7'")))
    return rows.join(rows.agg(F.max("timestamp").alias("timestamp")), "timestamp", "left_semi")


#: Keys to look up: days of clicks, shifted so that many have no point.
KEYS = f"SELECT DISTINCT 'user.' || CAST(user_id AS VARCHAR) AS measurement, CAST(epoch_us(ts) * 1000 - (epoch_us(ts) * 1000) % {DAY} + (event_id % 3) * {DAY} AS BIGINT) AS timestamp FROM events WHERE event_type = 'click'"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = nanos(F.col("ts"))
    rows = events(spark, sf_dir).where("event_type = 'click'")
    return rows.select(F.concat(F.lit("user."), F.col("user_id").cast("string")).alias("measurement"), (t - F.pmod(t, F.lit(DAY)) + F.col("event_id") % 3 * F.lit(DAY)).alias("timestamp"))


@query(f"SELECT k.measurement, k.timestamp, p.value_num FROM ({KEYS}) k LEFT JOIN ({LIVE}) p USING (measurement, timestamp)")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir)
    return as_number(lookup.multi_get(resolve.live(lookup.of_keys(oplog(spark, sf_dir), keys)), keys))


@query(f"SELECT k.measurement, k.timestamp FROM ({KEYS}) k ANTI JOIN ({LIVE}) p USING (measurement, timestamp)")
def multi_get_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir)
    return lookup.missing(resolve.live(lookup.of_keys(oplog(spark, sf_dir), keys)), keys)


@query(f"SELECT measurement, timestamp, value_num, deleted, seq FROM ({OPLOG}) WHERE measurement = 'user.7'")
def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_number(oplog(spark, sf_dir).where("measurement = 'user.7'")).select("measurement", "timestamp", "value_num", "deleted", "seq")


@query(f"SELECT measurement, timestamp, value_num, seq FROM ({OPLOG}) WHERE NOT deleted")
def wal_replay_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_number(oplog(spark, sf_dir).where(~F.col("deleted"))).select("measurement", "timestamp", "value_num", "seq").orderBy("seq")


@query(f"SELECT * FROM ({LIVE}) WHERE (measurement > 'user.12' OR (measurement = 'user.12' AND timestamp >= {FROM})) AND (measurement < 'user.5' OR (measurement = 'user.5' AND timestamp <= {TO}))")
def key_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = resolve.key_between(("user.12", FROM), ("user.5", TO))
    return as_number(resolve.live(oplog(spark, sf_dir).where(bounds))).orderBy("measurement", "timestamp")


@query(f"SELECT measurement, timestamp, seq, CAST(row_number() OVER (PARTITION BY measurement ORDER BY timestamp, seq) AS BIGINT) AS ord FROM ({OPLOG})")
def key_order_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position within the series; blocks of days are ranked apart, so that no task gets a whole series."""
    rows = oplog(spark, sf_dir).select("measurement", "timestamp", "seq")
    return series.running_sum(rows, F.lit(1).cast("long"), ["timestamp", "seq"], series.time_block(), "ord")


# downsampling


#: An odd anchor before all events, and a time after them.
T0, T1 = 1_704_067_200_000_000_000 - DAY + 17 * 60 * 1_000_000_000, 1_704_067_200_000_000_000 + 366 * DAY
BUCKETED = f"SELECT measurement, {T0} + (timestamp - {T0}) // {HOUR} * {HOUR} AS bucket, timestamp, value_num FROM ({POINTS}) WHERE timestamp BETWEEN {T0} AND {T1}"


def _downsample_sql(agg: str) -> str:
    return f"SELECT measurement, CAST(bucket AS BIGINT) AS timestamp, {agg} AS value_num FROM ({BUCKETED}) GROUP BY 1, 2"


EXACT_AVG = "CAST(sum(CAST(value_num AS DECIMAL(18,4))) AS DOUBLE) / count(*)"


@query(_downsample_sql(EXACT_AVG))
def downsample_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum is exact, so that the result doesn't hang on the order of partial sums."""
    rows = resolve.in_range(points(spark, sf_dir), None, T0, T1)
    groups = rows.groupBy("measurement", ds.bucket(T0, HOUR).alias("bucket"))
    total = F.sum(F.col("value").cast("double").cast("decimal(18,4)")).cast("double")
    return groups.agg((total / F.count("*")).alias("value_num")).withColumnRenamed("bucket", "timestamp")


@query(_downsample_sql("max(value_num)"))
def downsample_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.downsample(points(spark, sf_dir), None, T0, T1, HOUR, "max")


@query(_downsample_sql("min(value_num)"))
def downsample_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.downsample(points(spark, sf_dir), None, T0, T1, HOUR, "min")


@query(_downsample_sql("arg_max(value_num, timestamp)"))
def downsample_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_number(ds.downsample(points(spark, sf_dir), None, T0, T1, HOUR, "last"))


@query(f"SELECT measurement, CAST(timestamp // {DAY} * {DAY} AS BIGINT) AS timestamp, CAST(sum(CAST(value_num AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_value, max(value_num) AS max_value, min(value_num) AS min_value, arg_max(value_num, timestamp) AS last_value, count(*) AS n FROM ({POINTS}) GROUP BY 1, 2")
def downsample_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four aggregates in one pass."""
    v = F.col("value").cast("double")
    groups = points(spark, sf_dir).withColumn("v", v).groupBy("measurement", ds.bucket(0, DAY).alias("bucket"))
    return groups.agg(
        (F.sum(F.col("v").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("avg_value"), F.max("v").alias("max_value"), F.min("v").alias("min_value"), F.max_by("v", "timestamp").alias("last_value"), F.count("*").alias("n")
    ).withColumnRenamed("bucket", "timestamp")


@query(f"SELECT measurement, {EXACT_AVG} AS value_num FROM ({POINTS}) GROUP BY 1")
def series_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.col("value").cast("double").cast("decimal(18,4)")).cast("double")
    return points(spark, sf_dir).groupBy("measurement").agg((total / F.count("*")).alias("value_num"))


@query(
    f"""SELECT 'part.' || CAST(l_partkey AS VARCHAR) AS measurement, CAST(epoch_us(l_shipdate) * 1000 // {28 * DAY} * {28 * DAY} AS BIGINT) AS timestamp,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_value, max(l_quantity) AS max_value FROM lineitem GROUP BY 1, 2"""
)
def downsample_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = shipments(spark, sf_dir).groupBy("measurement", ds.bucket(0, 28 * DAY).alias("bucket"))
    total = F.sum(F.col("value_num").cast("decimal(18,2)")).cast("double")
    return groups.agg((total / F.count("*")).alias("avg_value"), F.max("value_num").alias("max_value")).withColumnRenamed("bucket", "timestamp")


# batches


@query(f"SELECT * FROM ({LIVE}) WHERE measurement = 'user.7'")
def write_batch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One client's operations, in their order, as one batch."""
    batch = WriteBatch()
    for r in oplog(spark, sf_dir).where("measurement = 'user.7'").orderBy("seq").toLocalIterator():
        batch = batch.delete(r.measurement, r.timestamp) if r.deleted else batch.put(r.measurement, r.timestamp, r.value)
    return as_number(resolve.live(batch.to_df(spark).withColumnRenamed("op_idx", "seq")))


@query(f"SELECT l.* FROM ({LIVE}) l SEMI JOIN (SELECT * FROM ({OPLOG}) WHERE deleted) USING (measurement, timestamp)")
def put_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live points of keys that were deleted before."""
    ops = oplog(spark, sf_dir)
    return as_number(resolve.live(lookup.of_keys(ops, ops.where("deleted"))))


# maintenance


TTL_15 = 15 * 86_400


@query(f"SELECT l.measurement, l.timestamp, l.value_num, l.deleted, l.seq FROM ({LATEST}) l JOIN ({MARKS}) m USING (measurement) WHERE l.timestamp >= m.latest_timestamp - {TTL_15} * 1000000000::BIGINT")
def compaction_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = oplog(spark, sf_dir)
    marks = resolve.watermarks(ops)
    rules = marks.select("measurement", F.lit(TTL_15).cast("long").alias("ttl_seconds"))
    return as_number(maintain.merge(ops, resolve.horizons(rules, marks))).select("measurement", "timestamp", "value_num", "deleted", "seq")


@query("SELECT 0::BIGINT AS changed")
def compaction_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that differ between the log and the log merged in two steps."""
    ops = oplog(spark, sf_dir)
    cols = ["measurement", "timestamp", "value", "deleted", "seq"]
    half = maintain.merge(ops.where("seq % 2 = 0")).select(cols).unionByName(ops.where("seq % 2 = 1").select(cols))
    a, b = resolve.live(ops), resolve.live(maintain.merge(half))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("changed"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest as eight files of the log would give it."""
    key = F.struct("measurement", "timestamp")
    return oplog(spark, sf_dir, F.col("props")).groupBy((F.col("seq") % 8).alias("file_number")).agg(F.min(key).alias("smallest"), F.max(key).alias("largest"), F.sum(codec.entry_bytes()).cast("long").alias("file_size")).withColumn("level", F.when(F.col("file_number") < 4, 0).otherwise(1))


FILES = f"SELECT seq % 8 AS file_number, min({{'m': measurement, 't': timestamp}}) AS lo, max({{'m': measurement, 't': timestamp}}) AS hi, sum(strlen(measurement) + strlen(props) + 72) AS size, CAST(seq % 8 >= 4 AS INTEGER) AS level FROM ({OPLOG}) GROUP BY seq % 8"


@query(f"SELECT file_number, lo.m AS low_measurement, lo.t AS low_timestamp, hi.m AS high_measurement, hi.t AS high_timestamp FROM ({FILES})")
def zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select(
        "file_number", F.col("smallest.measurement").alias("low_measurement"), F.col("smallest.timestamp").alias("low_timestamp"), F.col("largest.measurement").alias("high_measurement"), F.col("largest.timestamp").alias("high_timestamp")
    )


#: Files by 1,000 events, so that their spans of time differ.
SPANS = "SELECT event_id // 1000 AS file_number, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events GROUP BY 1"


@query(f"SELECT a.file_number AS file_number, b.file_number AS overlapping FROM ({SPANS}) a JOIN ({SPANS}) b ON NOT (a.hi < b.lo OR a.lo > b.hi)")
def overlap_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files whose spans overlap; each is cut into days, so that it is an equi-join."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    day = 86_400_000_000
    spans = events(spark, sf_dir).groupBy((F.col("event_id") - F.col("event_id") % 1000).alias("k")).agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    spans = spans.select((F.col("k") / 1000).cast("long").alias("file_number"), "lo", "hi")
    cut = spans.withColumn("day", F.explode(F.sequence(F.floor(F.col("lo") / day), F.floor(F.col("hi") / day))))
    a, b = cut.alias("a"), cut.alias("b")
    pairs = a.join(b, (F.col("a.day") == F.col("b.day")) & ~((F.col("a.hi") < F.col("b.lo")) | (F.col("a.lo") > F.col("b.hi"))))
    return pairs.select(F.col("a.file_number").alias("file_number"), F.col("b.file_number").alias("overlapping")).distinct()


@query(f"SELECT level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM ({FILES}) GROUP BY 1")
def level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.level_stats(_files(spark, sf_dir)).select("level", "files", "bytes")


@query("SELECT DISTINCT lpad(CAST(event_id % 8 AS VARCHAR), 6, '0') AS file_name FROM events WHERE event_id % 8 >= 4")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of eight files of the log those that a manifest with level 0 only doesn't name."""
    files = _files(spark, sf_dir).withColumn("file_name", F.lpad(F.col("file_number").cast("string"), 6, "0"))
    return maintain.orphans(files.select("file_name"), files.where("level = 0").select("file_name"))


@query(f"SELECT measurement, CAST(sum(strlen(measurement) + strlen(props) + 72) AS BIGINT) AS bytes, count(*) AS entries FROM ({OPLOG}) GROUP BY 1")
def memtable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' properties are the values here: their text is the same in every engine."""
    return oplog(spark, sf_dir, F.col("props")).groupBy("measurement").agg(F.sum(codec.entry_bytes()).cast("long").alias("bytes"), F.count("*").alias("entries"))


# codecs


DOD = f"""SELECT measurement, timestamp, delta, CAST(delta - coalesce(lag(delta) OVER (PARTITION BY measurement ORDER BY timestamp), CASE WHEN delta IS NOT NULL THEN 0 END) AS BIGINT) AS dod
  FROM (SELECT measurement, timestamp, timestamp - lag(timestamp) OVER (PARTITION BY measurement ORDER BY timestamp) AS delta FROM ({POINTS}))"""


@query(DOD)
def dod_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.dod(points(spark, sf_dir).select("measurement", "timestamp"))


@query(f"SELECT measurement, CAST(sum(CASE WHEN dod = 0 THEN 1 WHEN abs(dod) <= 63 THEN 9 WHEN abs(dod) <= 8191 THEN 17 ELSE 68 END) AS BIGINT) AS bits FROM ({DOD}) WHERE dod IS NOT NULL GROUP BY 1")
def dod_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codec.dod(points(spark, sf_dir).select("measurement", "timestamp")).where("dod IS NOT NULL")
    return rows.groupBy("measurement").agg(F.sum(codec.bits(F.col("dod"))).alias("bits"))


@query(f"SELECT measurement, timestamp FROM ({POINTS})")
def dod_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps, through deltas of deltas and back."""
    coded = codec.dod(points(spark, sf_dir).select("measurement", "timestamp"))
    coded = series.running_sum(coded, F.lit(1).cast("long"), ["timestamp"], series.time_block(), "ord")
    firsts = coded.groupBy("measurement").agg(F.min("timestamp").alias("first_timestamp"))
    return codec.rebuild(coded.select("measurement", "dod", "ord").join(firsts, "measurement")).select("measurement", "timestamp")


@query(f"SELECT measurement, timestamp FROM ({POINTS})")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps, through the byte codes and back."""
    return codec.decode_series(codec.encode_series(points(spark, sf_dir)))


#: The reflected polynomial of IEEE's CRC-32; DuckDB has no function for it, so its table is built by the rule.
POLYNOMIAL, ONES = 0xEDB88320, 0xFFFFFFFF
CRC = f"""WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END, b)) AS step),
texts AS (SELECT seq, hex(encode(value)) AS hx FROM ({POINTS})),
bytes AS (SELECT seq, list_transform(range(len(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT)) AS data FROM texts)
SELECT seq, xor(list_reduce(data, lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), {ONES}::BIGINT), {ONES}) AS crc FROM bytes, steps"""


@query(CRC)
def crc32_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("seq", codec.checksum(F.encode("value", "utf-8")).alias("crc"))


# streaming and the store


def _scratch(spark: SparkSession, kind: str) -> str:
    """A new folder that the driver and the executors share."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or '/tmp/checkpoints'}/tidemark/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def _staged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The log as a stream of four files, oldest first, and a folder for checkpoints."""
    at = _scratch(spark, "stream")
    ops = oplog(spark, sf_dir)
    n = ops.agg(F.max("seq")).first()[0] + 1
    for k in range(4):
        ops.where((F.col("seq") >= n * k // 4) & (F.col("seq") < n * (k + 1) // 4)).coalesce(1).write.mode("append").parquet(f"{at}/in")
    return spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in"), at


@query(LIVE)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log through a stream into a store: files of the stream are in order of the sequence."""
    from tidemark.sources.store import Store
    from tidemark.streaming import ingest

    stream, at = _staged(spark, sf_dir)
    store = Store(spark, f"{at}/store")
    ingest.ingest(store, stream.withColumnRenamed("seq", "op_idx"), f"{at}/cp").awaitTermination()
    return as_number(store.points())


@query(f"SELECT measurement, CAST(timestamp // {7 * DAY} * {7 * DAY} AS BIGINT) AS bucket, CAST(sum(CAST(value_num AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS n FROM ({OPLOG}) WHERE NOT deleted GROUP BY 1, 2")
def stream_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.streaming import ingest

    stream, at = _staged(spark, sf_dir)
    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/sums/batch={batch_id}")

    sums = ingest.downsample(stream.where(~F.col("deleted")), 0, 7 * DAY)
    sums.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    newest = spark.read.parquet(f"{at}/sums").groupBy("measurement", "bucket").agg(F.max_by(F.struct("total", "n"), "batch").alias("x"))
    return newest.select("measurement", "bucket", F.col("x.total").cast("double").alias("total"), F.col("x.n").alias("n"))


@query(MARKS)
def stream_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.streaming import ingest

    stream, at = _staged(spark, sf_dir)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/marks/batch={batch_id}")

    ingest.series_watermarks(stream).writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/marks").groupBy("measurement").agg(F.max("latest_timestamp").alias("latest_timestamp"))


@query(LIVE)
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as three commits of a store, then a compaction and a reopening."""
    from tidemark.sources.store import Store

    path = _scratch(spark, "store")
    ops = oplog(spark, sf_dir).withColumnRenamed("seq", "op_idx")
    n = ops.agg(F.max("op_idx")).first()[0] + 1
    with Store(spark, path) as store:
        for k in range(3):
            store.write(ops.where((F.col("op_idx") >= n * k // 3) & (F.col("op_idx") < n * (k + 1) // 3)))
        store.compact()
    return as_number(Store(spark, path).points())


@query(f"SELECT measurement, timestamp, value_num FROM (SELECT * FROM ({OPLOG}) WHERE seq * 2 <= (SELECT max(event_id) FROM events) QUALIFY row_number() OVER (PARTITION BY measurement, timestamp ORDER BY seq DESC) = 1) WHERE NOT deleted")
def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader that opened after half of the log sees once a writer has written the rest, compacted and closed."""
    from tidemark.sources.store import Store

    path = _scratch(spark, "snapshot")
    ops = oplog(spark, sf_dir).withColumnRenamed("seq", "op_idx")
    half = F.col("op_idx") * 2 <= ops.agg(F.max("op_idx")).first()[0]
    with Store(spark, path) as writer:
        writer.write(ops.where(half))
        reader = Store(spark, path)
        writer.write(ops.where(~half))
        writer.compact()
    return as_number(reader.points())


@query("SELECT 1::BIGINT AS version_files, 1::BIGINT AS level0_files, 0::BIGINT AS deeper_files, 1::BIGINT AS disk_sst_files, true AS has_bytes, 0::BIGINT AS pending_delete_files, false AS compaction_pending, (SELECT count(*) FROM events) AS entries")
def engine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources.store import Store

    with Store(spark, _scratch(spark, "stats")) as store:
        store.write(oplog(spark, sf_dir).withColumnRenamed("seq", "op_idx"))
        deeper = F.aggregate(F.slice("level_files", 2, 6), F.lit(0).cast("long"), lambda a, x: a + x).alias("deeper_files")
        return store.stats().select("version_files", F.col("level_files")[0].alias("level0_files"), deeper, "disk_sst_files", (F.col("version_file_bytes") > 0).alias("has_bytes"), "pending_delete_files", "compaction_pending", F.lit(store.count()).cast("long").alias("entries"))
