"""The fixed schemas. Timestamps are BIGINT nanoseconds throughout: TIMESTAMP would lose three digits."""

from pyspark.sql import types as T

#: Nanoseconds in a second.
NS = 1_000_000_000
#: ``seq = commit << SEQ_SHIFT | op_idx``: newer commits win, and later operations within a commit.
SEQ_SHIFT = 32

OP_LOG = T.StructType(
    [
        T.StructField("measurement", T.StringType(), False),
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("value", T.StringType(), False),
        T.StructField("deleted", T.BooleanType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)

BATCH = T.StructType(
    [
        T.StructField("measurement", T.StringType(), False),
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("value", T.StringType(), False),
        T.StructField("deleted", T.BooleanType(), False),
        T.StructField("op_idx", T.LongType(), False),
    ]
)

POINTS = T.StructType([T.StructField(f.name, f.dataType, False) for f in OP_LOG.fields[:3]])

TTL_RULES = T.StructType([T.StructField("measurement", T.StringType(), False), T.StructField("ttl_seconds", T.LongType(), False)])

_KEY = T.StructType([T.StructField("measurement", T.StringType()), T.StructField("timestamp", T.LongType())])

MANIFEST = T.StructType(
    [
        T.StructField("level", T.IntegerType(), False),
        T.StructField("file_number", T.LongType(), False),
        T.StructField("file_name", T.StringType(), False),
        T.StructField("file_size", T.LongType(), False),
        T.StructField("smallest", _KEY),
        T.StructField("largest", _KEY),
    ]
)

STATS = T.StructType(
    [
        T.StructField("version_files", T.LongType()),
        T.StructField("level_files", T.ArrayType(T.LongType())),
        T.StructField("disk_sst_files", T.LongType()),
        T.StructField("version_file_bytes", T.LongType()),
        T.StructField("sstable_candidate_count", T.LongType()),
        T.StructField("sstable_probe_count", T.LongType()),
        T.StructField("memtable_bytes", T.LongType()),
        T.StructField("immutable_bytes", T.LongType()),
        T.StructField("flush_in_progress", T.BooleanType()),
        T.StructField("block_cache_hits", T.LongType()),
        T.StructField("block_cache_misses", T.LongType()),
        T.StructField("block_cache_bytes", T.LongType()),
        T.StructField("block_cache_entries", T.LongType()),
        T.StructField("compaction_in_progress", T.BooleanType()),
        T.StructField("compaction_pending", T.BooleanType()),
        T.StructField("compacting_files", T.LongType()),
        T.StructField("pending_delete_files", T.LongType()),
    ]
)
