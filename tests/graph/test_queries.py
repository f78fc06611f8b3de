"""Every query against its SQL in DuckDB, on the tables of the smallest size."""

import duckdb
import pytest

from weftgraph.catalogue import ORACLE_SQL, QUERIES
from weftgraph.sources.bindings import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    out = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in out.fetchall())
    assert got == want
