"""The queries that SQL can express, against it."""

import duckdb
import pytest

from sessionlake.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("pages", "conversations", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    cursor = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    df = registry.QUERIES[name](spark, sf_dir).select(names)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, cursor.fetchall()))
