"""tidemark: a Spark-native engine for versioned time-series points."""

from tidemark.errors import CorruptionError, InvalidArgumentError, NotFoundError, TidemarkError
from tidemark.operators.batch import WriteBatch
from tidemark.sources.store import Options, Store

__all__ = [
    "CorruptionError",
    "InvalidArgumentError",
    "NotFoundError",
    "Options",
    "Store",
    "TidemarkError",
    "WriteBatch",
]
