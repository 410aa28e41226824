"""Every registered query of the engine against its SQL."""

from pathlib import Path

import duckdb
import pytest

from compare import normal
from tidemark.plans import timeseries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(timeseries.QUERIES))
def test_query(spark, con, name):
    df = timeseries.QUERIES[name](spark, SF)
    mine = normal([tuple(r) for r in df.collect()], df.columns)
    if name in timeseries.SQL:
        rel = con.sql(timeseries.SQL[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert mine == normal(rel.fetchall(), rel.columns)


def test_result_does_not_hang_on_partitioning(spark):
    from tidemark.operators import resolve

    ops = timeseries.oplog(spark, SF)
    a = sorted(map(tuple, resolve.live(ops).collect()))
    assert a == sorted(map(tuple, resolve.live(ops.repartition(7, "value")).collect()))
