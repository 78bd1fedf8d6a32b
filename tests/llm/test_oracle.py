"""Queries against their SQL on the smallest tables."""

import os

import pytest

from leafworks.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, DATA).toPandas()
    key = lambda d: sorted(map(tuple, d[sorted(d.columns)].itertuples(index=False)))
    assert sorted(want.columns) == sorted(got.columns) and len(want) and key(want) == key(got)
