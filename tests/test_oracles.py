"""Every core query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from codequarry.plans import catalogue

DATA = os.environ.get("CODEQUARRY_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(_plain, v)) if isinstance(v, list | tuple) else v


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sql, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    oracle = catalogue.oracle_sql().get(name)
    if oracle is None:
        assert got
        return
    found = sql.sql(oracle)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    assert sorted(found.columns) == columns
    assert _sorted(got) == _sorted([tuple(_plain(r[i]) for i in order) for r in found.fetchall()])


def test_no_oracle_without_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
