import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.errors import CorruptionError
from tidemark.functions import codec


@pytest.mark.parametrize("times", [[], [7], [1000, 1010, 1020], [0, 100, 250, 401], [-5, 5, 4, 10**15, 0], [0, 2**61, 1]])
def test_round_trip(times):
    assert codec.decode(codec.encode(times)) == times


@settings(max_examples=200)
@given(st.lists(st.integers(-(2**60), 2**60), max_size=40))
def test_any_timestamps(times):
    assert codec.decode(codec.encode(times)) == times


def test_regular_series_takes_a_bit_a_point():
    assert len(codec.encode(range(0, 80_000, 10))) < 8_000 // 8 + 16


def test_cut_code():
    with pytest.raises(CorruptionError):
        codec.decode(codec.encode([0, 100, 250, 401])[:-1])


def test_columns(spark):
    df = spark.createDataFrame([("m", t) for t in (0, 100, 250, 401)], "measurement string, timestamp long")
    out = codec.dod(df).orderBy("timestamp").collect()
    assert [r.delta for r in out] == [None, 100, 150, 151] and [r.dod for r in out] == [None, 100, 50, 1]


def test_series_round_trip(spark):
    draw = random.Random(3)
    rows = sorted({(m, draw.randrange(-(10**14), 10**15)) for m in "abc" for _ in range(50)})
    df = spark.createDataFrame(rows, "measurement string, timestamp long")
    assert sorted(map(tuple, codec.decode_series(codec.encode_series(df)).collect())) == rows


def test_crc(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(codec.checksum(F.lit("hello").cast("binary")), codec.checksum(F.lit("123456789").cast("binary"))).first()
    assert tuple(row) == (907060870, 3421780262)
