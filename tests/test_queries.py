"""Every core query against its SQL on the smallest tables."""

import math
import os

import pytest

from shelfmark.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == ordered(tuple(plain(r[i]) for i in places) for r in cursor.fetchall())


def test_no_query_names_a_missing_function():
    assert set(registry.oracle_sql()) <= set(registry.queries())
