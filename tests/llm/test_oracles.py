"""Queries that SQL can express, against it."""

import duckdb
import pytest

from tallyloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = c.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))
