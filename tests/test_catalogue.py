"""Every query with an oracle against DuckDB on the smallest tables, as the driver compares them."""

import os

import duckdb
import pytest

from quire.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_oracle(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    cur = con.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted([norm([r[cols.index(c)] for c in order]) for r in cur.fetchall()], key=str)
    got = sorted([norm([r[c] for c in order]) for r in df.collect()], key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).columns
