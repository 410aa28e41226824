from pyspark.sql import functions as F

from tidemark import Store
from tidemark.streaming import ingest


def source(spark, path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "measurement string, timestamp long, value string, deleted boolean, op_idx long").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


ROWS = [[("m", 1, "a", False, 0), ("m", 2, "b", False, 1), ("m", 1, "", True, 2)], [("m", 2, "c", False, 0), ("m", -9, "late", False, 1)]]


def test_ingest_and_replay(spark, tmp_path):
    stream = source(spark, str(tmp_path / "in"), ROWS)
    store = Store(spark, str(tmp_path / "store"))
    ingest.ingest(store, stream, str(tmp_path / "cp")).awaitTermination()
    want = [("m", -9, "late"), ("m", 2, "c")]
    assert sorted(map(tuple, store.points().collect())) == want
    version = store.state["version"]
    ingest.ingest(store, stream, str(tmp_path / "cp2")).awaitTermination()  # the same batches again
    assert store.state["version"] == version and sorted(map(tuple, Store(spark, store.path).points().collect())) == want


def test_watermarks_rise_only(spark, tmp_path):
    stream = source(spark, str(tmp_path / "in"), ROWS)
    ingest.series_watermarks(stream).writeStream.outputMode("update").format("memory").queryName("marks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("marks").agg(F.max("latest_timestamp"), F.count("*")).first() == (2, 1)
