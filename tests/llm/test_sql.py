"""The training-data queries that SQL can express equal DuckDB."""

import os

import duckdb
import pytest

from bytelode.llm import registry

TABLES = "documents embeddings benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    want = con.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, sf_dir).select(want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
