"""Every registered query against its SQL on the smallest tables."""
import os

import duckdb
import pandas
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def rows(frame):
    """Rows in order, columns by name; a missing value of any kind is null and comes last."""
    frame = frame[sorted(frame.columns)]
    every = [tuple(None if v is None or v is pandas.NA or v != v else v for v in r) for r in frame.itertuples(index=False, name=None)]
    return sorted(every, key=lambda r: [(v is None, 0 if v is None else v) for v in r])


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 40
    assert not set(entry.oracle_sql()) - set(entry.queries())
