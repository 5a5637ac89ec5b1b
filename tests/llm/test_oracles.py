"""The queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from codexmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF):
        duck.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(clean(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(clean(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
