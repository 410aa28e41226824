"""Delta-of-delta codes of timestamps: as columns, and as bytes.

The bit classes of a delta of deltas d are: ``0`` for 0; ``10`` and 7 bits for up to 63 in magnitude;
``110`` and 14 bits for up to 8191; ``1110`` and 64 bits for the rest; sign first, then magnitude.
The first delta counts as its own delta of deltas.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import CorruptionError
from tidemark.operators import series

#: (largest magnitude, prefix bits, prefix length, bits of sign and magnitude)
_CLASSES = ((0, 0b0, 1, 0), (63, 0b10, 2, 7), (8191, 0b110, 3, 14), ((1 << 63) - 1, 0b1110, 4, 64))


def dod(df: DataFrame) -> DataFrame:
    """Adds ``delta`` and ``dod`` to ``measurement, timestamp``; both NULL at the start of a series."""
    rows = series.before(df).withColumn("delta", F.col("timestamp") - F.col("_p"))
    return rows.withColumn("dod", F.col("delta") - F.coalesce(F.col("_p") - F.col("_pp"), F.when(F.col("delta").isNotNull(), F.lit(0)))).drop("_p", "_pp")


def rebuild(df: DataFrame, block_rows: int = 1 << 16) -> DataFrame:
    """From ``measurement, ord, first_timestamp, dod`` back to ``measurement, ord, timestamp``: two running sums."""
    block = F.col("ord") - F.pmod(F.col("ord"), F.lit(block_rows))
    deltas = series.running_sum(df, F.coalesce("dod", F.lit(0)), ["ord"], block, "_d")
    return series.running_sum(deltas, F.col("_d"), ["ord"], block, "_t").select("measurement", "ord", (F.col("first_timestamp") + F.col("_t")).alias("timestamp"))


def bits(d: Column) -> Column:
    """Bits that a delta of deltas takes."""
    size = F.abs(d)
    return F.when(d == 0, F.lit(1)).when(size <= 63, F.lit(9)).when(size <= 8191, F.lit(17)).otherwise(F.lit(68)).cast("long")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _unvarint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            raise CorruptionError("the code ends inside a number")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def encode(timestamps: Iterable[int]) -> bytes:
    """Count, first timestamp, then the classes, padded to whole bytes."""
    times = [int(t) for t in timestamps]
    head = _varint(len(times)) + (_varint(times[0] & (1 << 64) - 1) if times else b"")
    stream, length, previous = 0, 0, 0
    pieces = []
    for a, b in zip(times, times[1:]):
        change, previous = (b - a) - previous, b - a
        _, prefix, n_prefix, n = next(c for c in _CLASSES if abs(change) <= c[0])
        word = prefix << n | ((change < 0) << (n - 1) | abs(change) if n else 0)
        pieces.append(f"{word:0{n_prefix + n}b}")
    text = "".join(pieces)
    length = -(-len(text) // 8)
    stream = int(text.ljust(length * 8, "0") or "0", 2)
    return head + stream.to_bytes(length, "big")


def decode(data: bytes) -> list[int]:
    count, at = _unvarint(data, 0)
    if not count:
        return []
    first, at = _unvarint(data, at)
    first -= (first >> 63) << 64
    text = "".join(f"{b:08b}" for b in data[at:])
    out, delta, i = [first], 0, 0
    for _ in range(count - 1):
        ones = 0
        while ones < 3 and text[i + ones : i + ones + 1] == "1":
            ones += 1
        _, _, n_prefix, n = _CLASSES[ones]
        word = text[i + n_prefix : i + n_prefix + n]
        if i + n_prefix + n > len(text):
            raise CorruptionError("the code ends too early")
        delta += (-1 if word[0] == "1" else 1) * int(word[1:], 2) if n else 0
        out.append(out[-1] + delta)
        i += n_prefix + n
    return out


def encode_series(df: DataFrame, block_ns: int = 86_400_000_000_000) -> DataFrame:
    """``measurement, block, code``: one code for each series and block of time, so that no task gets a whole series."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"measurement": [pdf.measurement.iloc[0]], "block": [pdf.block.iloc[0]], "code": [encode(pdf.timestamp.sort_values())]})

    blocks = df.select("measurement", "timestamp", F.expr(f"floor(timestamp / {block_ns}D)").cast("long").alias("block"))
    return blocks.groupBy("measurement", "block").applyInPandas(pack, "measurement string, block long, code binary")


def decode_series(df: DataFrame) -> DataFrame:
    """``measurement, timestamp`` from ``measurement, code``."""

    def unpack(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            rows = [(m, t) for m, code in zip(pdf.measurement, pdf.code) for t in decode(code)]
            yield pd.DataFrame(rows, columns=["measurement", "timestamp"])

    return df.select("measurement", "code").mapInPandas(unpack, "measurement string, timestamp long")


def entry_bytes() -> Column:
    """Bytes that an entry takes in a write buffer: key, value, timestamp and 64 of overhead."""
    return F.octet_length("measurement") + F.octet_length("value") + F.lit(72)


def checksum(data: Column) -> Column:
    """CRC-32 (IEEE)."""
    return F.crc32(data)

