"""Every registered query of the engine against its SQL, at the smallest scale."""

import duckdb
import pytest

from sessionlake.plans import catalog

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def compare(df, sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = sorted(str(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    got = sorted(str(tuple(plain(v) for v in r)) for r in df.select(sorted(df.columns)).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    compare(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns
    df.count()
