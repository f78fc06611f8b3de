"""Queries that have SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from weftgraph.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    out = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(x)] for x in columns)) for r in out.fetchall())
    assert sorted(repr(tuple(r[x] for x in columns)) for r in df.collect()) == want
