"""What several operators share: scratch tables, fresh names, words."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session in one process may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: it cuts the lineage, and lost executors don't take it along.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Partitioned by a key into the session's number of partitions.

    Rows that stand for much work are few and small, and AQE would put them all in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def bounded(df: DataFrame) -> DataFrame:
    """The frame itself; its session hands at most 1,000 rows and about 16 MB at once to Python. A longer text is a batch of its own."""
    spark = df.sparkSession
    in_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < in_bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
    return df


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a column; one pass over it, one number to the driver."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def blocks_for(total: int, each: int) -> int:
    return max(1, -(-total // each))


def words(text: str | None) -> list[bytes]:
    """The words in UTF-8; ``bytes.split`` splits at the six characters that ``WORD`` leaves out."""
    return text.encode().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that scatters its input (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
