import pytest
from pyspark.sql import functions as F

from tidemark import Options, Store, WriteBatch
from tidemark.errors import ConflictError, InvalidArgumentError
from tidemark.schema import NS


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"))


def put_all(store, points, deleted=False):
    batch = WriteBatch()
    for m, t, v in points:
        batch = batch.delete(m, t) if deleted else batch.put(m, t, v)
    return store.write(batch)


def test_overwrite_delete_and_revive(store):
    store.put("m", 1, "v1")
    store.put("m", 1, "v2")
    assert rows(store.get("m", 1)) == [("m", 1, "v2")]
    store.delete("m", 1)
    assert rows(store.get("m", 1)) == []
    store.put("m", 1, "v3")
    assert rows(store.get("m", 1)) == [("m", 1, "v3")]
    assert rows(store.get("m", 2)) == rows(store.get("none", 1)) == []


def test_batch_is_one_commit_and_later_operations_win(store):
    n = store.write(WriteBatch().put("obs.qps", 1, "10").put("obs.qps", 2, "11").delete("obs.qps", 1))
    assert n == 1 and len(store.segments) == 1
    assert rows(store.points()) == [("obs.qps", 2, "11")]
    assert store.write(WriteBatch()) == 0 and len(store.segments) == 1


def test_range_is_inclusive_and_ordered(store):
    put_all(store, [("imu", 1000, "0.1"), ("imu", 2000, "0.2"), ("imu", 1500, "0.15"), ("x", 1500, "9")])
    assert [r[1] for r in rows(store.range_query("imu", 1000, 2000))] == [1000, 1500, 2000]
    assert rows(store.range_query("imu", 2000, 1000)) == []


def test_negative_timestamps_empty_names_and_values(store):
    put_all(store, [("", -5, ""), ("a b", -1, "x"), ("ÿz", 0, "y")])
    assert rows(store.get("", -5)) == [("", -5, "")]
    assert rows(store.range_query("a b", -10, 10)) == [("a b", -1, "x")]
    store.compact()
    assert store.points().count() == 3


def test_key_range_spans_series(store):
    put_all(store, [("b", 10, "1"), ("a", 30, "2"), ("a", 10, "3"), ("a", 20, "4"), ("c", 1, "5")])
    assert [r[:2] for r in rows(store.key_range_scan(("a", 20), ("b", 10)))] == [("a", 20), ("a", 30), ("b", 10)]
    store.delete("a", 30)
    assert [r[:2] for r in rows(store.key_range_scan(("a", 20), ("b", 10)))] == [("a", 20), ("b", 10)]
    assert [r[3] for r in rows(store.key_range_scan(("a", 20), ("b", 10), raw=True))] == [False, True, False]


def test_ttl_keeps_the_boundary_survives_reopening_and_moves_with_deletes(spark, store):
    put_all(store, [("temp", 0, "a"), ("temp", NS, "b"), ("temp", 2 * NS, "c"), ("other", 0, "d")])
    store.set_ttl("temp", 1)
    again = Store(spark, store.path)
    assert [r[1] for r in rows(again.range_query("temp", 0, 10 * NS))] == [NS, 2 * NS]
    assert rows(again.get("temp", 0)) == [] and again.points().count() == 3
    again.delete("temp", 50 * NS)
    assert rows(again.range_query("temp", 0, 100 * NS)) == []
    again.set_ttl("temp", 0)
    assert again.points().count() == 4


def test_ttl_compaction_drops_expired_rows(store):
    put_all(store, [("temp", 0, "a"), ("temp", NS, "b"), ("temp", 2 * NS, "c")])
    put_all(store, [("temp", 3 * NS, "d")])
    store.set_ttl("temp", 1)
    before = rows(store.points())
    assert store.compact()
    assert sorted(rows(store.points())) == sorted(before)
    assert store.ops().count() == 2


def test_compaction_changes_no_result_and_cleans_up(spark, store):
    for k in range(5):
        put_all(store, [("cpu", i, str(k * 100 + i)) for i in range(20)])
    put_all(store, [("cpu", 3, "")], deleted=True)
    before = sorted(rows(store.points()))
    assert store.compact(cleanup=False)
    assert len(store.segments) == 1 and store.stats().first().pending_delete_files == 6
    assert sorted(rows(store.points())) == before and ("cpu", 0, "400") in before and len(before) == 19
    assert store.ops().where("deleted").count() == 1
    assert store.cleanup_obsolete() == [] and len(store.cleanup_obsolete(retain_s=0)) == 6
    assert sorted(rows(Store(spark, store.path).points())) == before
    from tidemark.sources.maintain import compact

    assert compact(store, purge_tombstones=True) and store.ops().where("deleted").count() == 0
    assert sorted(rows(store.points())) == before


def test_compaction_of_nothing(store):
    assert not store.compact()


def test_due_after_enough_segments(spark, tmp_path):
    from tidemark.sources.maintain import due

    store = Store(spark, str(tmp_path / "d"), Options(level0_segments=2))
    store.put("m", 1, "a")
    assert not due(store)
    store.put("m", 2, "a")
    assert due(store)


def test_orphans_are_collected_on_closing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "o"), Options(retain_s=0))
    store.put("m", 1, "a")
    store.files.mkdirs("data/999999-orphan")
    store.close()
    assert [n for n, _, _ in store.files.list("data")] == [s.name for s in store.segments]
    with pytest.raises(InvalidArgumentError):
        store.put("m", 2, "b")
    store.close()


@pytest.mark.parametrize("retain_s", [0, 3600])
def test_a_stale_handle_deletes_nothing_live(spark, tmp_path, retain_s):
    first = Store(spark, str(tmp_path / "x"), Options(retain_s=retain_s))
    first.put("m", 1, "a")
    stale = Store(spark, first.path, Options(retain_s=retain_s))
    first.put("m", 2, "b")
    staged = first.write_segment(first.ops(), 0, 99)  # a writer at work
    stale.close()
    if retain_s:
        stale.cleanup_obsolete()
    assert sorted(rows(Store(spark, first.path).points())) == [("m", 1, "a"), ("m", 2, "b")]
    assert staged.name in [n for n, _, _ in first.files.list("data")]


def test_a_reader_keeps_its_version(spark, store):
    for k in range(4):
        store.put("m", 1, str(k))
    reader = Store(spark, store.path)
    store.compact()
    store.put("m", 1, "new")
    store.close()
    assert rows(reader.get("m", 1)) == [("m", 1, "3")] and rows(Store(spark, store.path).get("m", 1)) == [("m", 1, "new")]


def test_segments_are_found_without_a_manifest(spark, store):
    store.put("m", 1, "a")
    store.put("m", 1, "b")
    store.files.mkdirs("data/000009-torn")
    for name in store.versions():
        store.files.delete(f"manifest/{name}")
    again = Store(spark, store.path, Options(retain_s=0))
    assert rows(again.get("m", 1)) == [("m", 1, "b")] and again.state["next_commit"] == 3
    again.close()
    again = Store(spark, store.path)
    again.put("m", 1, "c")
    assert rows(Store(spark, store.path).get("m", 1)) == [("m", 1, "c")]


@pytest.mark.parametrize("op_idx", [-1, 1 << 32])
def test_op_idx_has_a_range(spark, store, op_idx):
    df = spark.createDataFrame([("m", 1, "a", False, op_idx)], "measurement string, timestamp long, value string, deleted boolean, op_idx long")
    with pytest.raises(Exception, match="op_idx must be"):
        store.write(df)
    assert store.empty() and store.write(df.withColumn("op_idx", F.lit((1 << 32) - 1))) == 1 and store.count() == 1


def test_one_of_two_writers_publishes(store):
    from concurrent.futures import ThreadPoolExecutor

    def publish(k):
        try:
            store.files.publish("manifest/x.json", str(k))
            return 1
        except ConflictError:
            return 0

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(publish, range(24))) == 1


def test_damaged_pages_are_an_error(spark, store):
    from pathlib import Path

    import pyarrow.parquet as pq

    put_all(store, [("m", k, f"value {k * 7919}") for k in range(2000)])
    path = next(p for p in Path(store.path).rglob("*.parquet"))
    for crc in Path(store.path).rglob("*.crc"):
        crc.unlink()
    data = bytearray(path.read_bytes())
    data[pq.ParquetFile(path).metadata.row_group(0).column(2).data_page_offset + 60] ^= 0xFF
    path.write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        store.points().collect()


def test_compaction_splits_its_output_by_bytes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "b"), Options(file_bytes=4096))
    for k in range(5):
        put_all(store, [("m", k * 200 + i, f"{k * 200 + i:080d}") for i in range(200)])
    store.compact()
    files = [n for n, _, _ in store.files.list(f"data/{store.segments[0].name}") if n.endswith(".parquet")]
    assert len(files) > 4 and store.count() == store.points().count() == 1000


def test_replay_visit_and_run(spark, tmp_path):
    from tidemark.sources import maintain

    store = Store(spark, str(tmp_path / "r"), Options(level0_segments=2))
    store.write(WriteBatch().put("b", 1, "x").put("a", 2, "y").delete("b", 1))
    store.put("a", 1, "z")
    assert [(r.measurement, r.deleted) for r in store.replay().collect()] == [("b", False), ("a", False), ("b", True), ("a", False)]
    seen = []
    assert store.visit(lambda *p: seen.append(p)) == 2 and seen == [("a", 1, "z"), ("a", 2, "y")]
    assert store.visit(lambda *p: False) == 1
    assert maintain.level0(store)[0] == 2 and maintain.run(store) == 1 and maintain.run(store) == 0 and maintain.level0(store) == (0, 0)


def test_second_writer_conflicts_and_changes_nothing(spark, store):
    other = Store(spark, store.path)
    store.put("m", 1, "a")
    with pytest.raises(ConflictError):
        other.put("m", 1, "b")
    assert rows(Store(spark, store.path).get("m", 1)) == [("m", 1, "a")]


def test_multi_get(spark, store):
    put_all(store, [("a", 1, "x"), ("b", 2, "y")])
    keys = spark.createDataFrame([("a", 1), ("a", 1), ("b", 3)], "measurement string, timestamp long")
    assert sorted(rows(store.multi_get(keys)), key=str) == [("a", 1, "x"), ("b", 3, None)]


def test_stats_has_seventeen_fields(store):
    store.put("m", 1, "a")
    store.get("m", 1).collect()
    r = store.stats().first()
    assert len(r) == 17 and r.version_files == 1 and r.level_files == [1, 0, 0, 0, 0, 0, 0] and r.sstable_probe_count == 1
    store.get("z", 1).collect()
    assert store.stats().first().sstable_probe_count == 1
    store.reset_read_stats()
    assert store.stats().first().sstable_candidate_count == 0


def test_demo_of_sensors(spark, store):
    t0 = 1_700_000_000_000_000_000
    ms = 1_000_000
    data = spark.range(100).select(F.lit("imu.accel.x").alias("measurement"), (F.lit(t0) + F.col("id") * 10 * ms).alias("timestamp"), F.format_string("%.6f", F.col("id") * 0.01).alias("value"), F.lit(False).alias("deleted"), F.col("id").alias("op_idx"))
    store.write(data)
    assert rows(store.get("imu.accel.x", t0 + 500 * ms))[0][2] == "0.500000"
    assert store.range_query("imu.accel.x", t0 + 200 * ms, t0 + 250 * ms).count() == 6
    got = [r.value_num for r in store.downsample("imu.accel.x", t0, t0 + 990 * ms, 100 * ms, "avg").collect()]
    assert got == pytest.approx([0.045 + 0.1 * i for i in range(10)])


def test_plan_pushes_filters(spark, store):
    store.put("m", 1, "a")
    plan = store.range_query("m", 0, 5)._jdf.queryExecution().toString()
    assert "EqualTo(measurement,m)" in plan and "GreaterThanOrEqual(timestamp,0)" in plan
