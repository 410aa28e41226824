import pytest

from tidemark.errors import InvalidArgumentError
from tidemark.operators.downsample import as_text, downsample
from tidemark.schema import POINTS


@pytest.fixture
def temp(spark):
    return spark.createDataFrame([("temp", i * 10, f"{i * 0.1:.6f}") for i in range(100)], POINTS)


def got(df, col="value_num"):
    return [(r.timestamp, r[col]) for r in df.orderBy("timestamp").collect()]


def test_avg(temp):
    out = got(downsample(temp, "temp", 0, 999, 100, "avg"))
    assert [t for t, _ in out] == list(range(0, 1000, 100))
    assert [v for _, v in out] == pytest.approx([0.45 + i for i in range(10)])


@pytest.mark.parametrize(("agg", "col", "first"), [("max", "value_num", 0.9), ("min", "value_num", 0.0), ("last", "value", "0.900000")])
def test_others(temp, agg, col, first):
    assert got(downsample(temp, "temp", 0, 999, 100, agg), col)[0] == (0, first)


def test_windows_start_at_the_query(temp):
    out = got(downsample(temp, "temp", 35, 250, 100, "max"))
    assert out == [(35, pytest.approx(1.3)), (135, pytest.approx(2.3)), (235, pytest.approx(2.5))]


def test_point_at_the_end_on_an_edge_opens_a_window(temp):
    assert got(downsample(temp, "temp", 0, 100, 50, "min"))[-1] == (100, 1.0)


def test_empty_windows_give_no_row(spark):
    df = spark.createDataFrame([("m", 0, "1"), ("m", 1000, "2")], POINTS)
    assert got(downsample(df, "m", 0, 2000, 10, "max")) == [(0, 1.0), (1000, 2.0)]


@pytest.mark.parametrize(("start", "end", "width"), [(0, 100, 0), (0, 100, -5), (100, 0, 10)])
def test_degenerate(temp, start, end, width):
    assert got(downsample(temp, "temp", start, end, width, "max")) == []


def test_negative_timestamps(spark):
    df = spark.createDataFrame([("m", -15, "1"), ("m", -5, "2")], POINTS)
    assert got(downsample(df, "m", -20, 0, 10, "max")) == [(-20, 1.0), (-10, 2.0)]


def test_bad_numbers(spark):
    df = spark.createDataFrame([("m", 0, "12abc"), ("m", 1, "3")], POINTS)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        downsample(df, "m", 0, 9, 10, "avg").collect()
    assert got(downsample(df, "m", 0, 9, 10, "avg", on_bad="null")) == [(0, 3.0)]
    assert got(downsample(df, "m", 0, 0, 10, "last"), "value") == [(0, "12abc")]
    assert got(downsample(df, "m", 0, 0, 10, "avg", on_bad="null")) == []


def test_nan_is_largest(spark):
    df = spark.createDataFrame([("m", 0, "NaN"), ("m", 1, "3")], POINTS)
    (r,) = downsample(df, "m", 0, 9, 10, "max").collect()
    assert r.value_num != r.value_num
    assert got(downsample(df, "m", 0, 9, 10, "min")) == [(0, 3.0)]


def test_unknown_aggregate(temp):
    with pytest.raises(InvalidArgumentError, match="InvalidArgument"):
        downsample(temp, "temp", 0, 1, 1, "sum")


def test_text(temp):
    assert got(as_text(downsample(temp, "temp", 0, 99, 100, "avg")), "value") == [(0, "0.450000")]
