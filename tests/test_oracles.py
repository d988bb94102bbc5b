"""Every query with SQL against DuckDB on the smallest tables; the others at least run, twice, with the same rows."""

import glob
import math
import os

import duckdb
import pytest

from cratewave import plans

DIRECTORY = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.everything()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIRECTORY}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIRECTORY)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = [tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_alike(spark, name):
    first, second = (sorted(map(repr, QUERIES[name](spark, DIRECTORY).collect())) for _ in range(2))
    assert first and first == second
