"""Which of very many 64-bit keys occur with two owners or more, at five bytes a key.

Rows are grouped in blocks. A block sends each of its distinct keys once, cut to 32 bits, and how often it has
it, to the bucket that the key's upper bits name, and gets two bits back for each. The number of buckets follows the number of keys,
so a bucket has a bounded share of them, and two different keys meet with the same small chance at every
size; such a meeting costs work later and changes no result. A key that a third of all rows have arrives
once from each block. A key that comes more often than a bound over all blocks is told to all as hot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.llm.common import dealt

#: Keys in a bucket, about.
BUCKET_KEYS = 1 << 20
SENT = "block long, bucket long, payload binary, many binary, counts binary"
BITS = "block long, bucket long, payload binary, hot binary"
#: What a block says of a key's count at most.
MOST = 255


def bucket_bits(keys: int) -> int:
    """Bits of the bucket's number for so many keys."""
    return max(0, int(keys // BUCKET_KEYS).bit_length())


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(keys.size, np.int64)


def slices(sorted_keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """``(bucket, from, to)`` of the buckets that have keys, in order."""
    bucket = bucket_of(sorted_keys, bits)
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if bucket.size else np.zeros(0, int)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(start, np.r_[start[1:], bucket.size])]


def unique_keys(keys: np.ndarray, owners: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, whether each has several owners, and how often each comes. ``alone`` marks places that count as several."""
    order = np.argsort(keys, kind="stable")
    k, o = keys[order], owners[order]
    new = np.r_[True, k[1:] != k[:-1]] if k.size else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    many = np.zeros(int(new.sum()), bool)
    if k.size > 1:
        many[group[1:][~new[1:] & (o[1:] != o[:-1])]] = True
    if alone is not None:
        many[group[alone[order]]] = True
    return k[new], many, np.bincount(group, minlength=many.size)


def _pack(a: np.ndarray) -> bytes:
    return np.packbits(a).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def send(block: int, keys: np.ndarray, many: np.ndarray, counts: np.ndarray, bits: int) -> pd.DataFrame:
    """Rows of SENT for a block's distinct keys in order."""
    short, counts = (keys >> np.uint64(32 - bits)).astype(np.uint32), np.minimum(counts, MOST).astype(np.uint8)
    rows = [(block, b, short[i:j].tobytes(), _pack(many[i:j]), counts[i:j].tobytes()) for b, i, j in slices(keys, bits)]
    return pd.DataFrame(rows, columns=["block", "bucket", "payload", "many", "counts"])


def meet(sent: DataFrame, hot: int) -> DataFrame:
    """From rows of SENT to rows of BITS: for each block and bucket, whether its keys have several owners, and come more than ``hot`` times."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(p, np.uint32) for p in pdf.payload]
        sizes = [p.size for p in parts]
        keys = np.concatenate(parts)
        many = np.concatenate([_unpack(m, n) for m, n in zip(pdf.many, sizes)])
        counts = np.concatenate([np.frombuffer(c, np.uint8) for c in pdf.counts])
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        group = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1
        shared = np.bincount(group) > 1
        shared[group[many[order]]] = True
        out = np.empty((2, keys.size), bool)
        out[:, order] = shared[group], (np.bincount(group, weights=counts[order]) > hot)[group]
        ends = np.cumsum(sizes)
        rows = [(_pack(out[0, e - n : e]), _pack(out[1, e - n : e])) for e, n in zip(ends, sizes)]
        return pd.DataFrame({"block": pdf.block, "bucket": pdf.bucket, "payload": [r[0] for r in rows], "hot": [r[1] for r in rows]})

    return dealt(sent, "bucket").groupBy("bucket").applyInPandas(run, BITS)


def received(answers: pd.DataFrame, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's answers for its distinct keys in order: shared, hot."""
    by = dict(zip(answers.bucket, zip(answers.payload, answers.hot)))
    shared, hot = np.zeros(keys.size, bool), np.zeros(keys.size, bool)
    for b, i, j in slices(keys, bits):
        shared[i:j], hot[i:j] = (_unpack(x, j - i) for x in by[b])
    return shared, hot
