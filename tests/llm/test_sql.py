"""Queries of the package against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n == "pipeline" or n.startswith("op")))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(map(tuple, result.fetchall()))
