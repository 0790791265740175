"""Every pN_ query of the subpackage on the smallest tables, against its SQL where there is one."""

import glob
import os

import duckdb
import pytest

from coalis.llm import oracle, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return str(value) if value is not None else None


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_all_sql_has_a_query():
    assert set(oracle.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    ours = df.collect()
    if name not in oracle.SQL:
        assert ours
        return
    theirs = duck.execute(oracle.SQL[name])
    columns = sorted(d[0] for d in theirs.description)
    assert sorted(df.columns) == columns
    order = [[d[0] for d in theirs.description].index(c) for c in columns]
    expected = sorted(str([plain(r[i]) for i in order]) for r in theirs.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in ours) == expected
