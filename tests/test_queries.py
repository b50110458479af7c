"""Registered queries against their SQL at the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.spark_queries.Q)))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "n_lines", "n_ads"] and df.count() == 200 and df.filter("n_ads > 0").count() == 5


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name, shuffles", [
    ("doc_ads", 0), ("srt_parse", 0), ("srt_roundtrip", 0), ("clean_srt_files", 0), ("clean_remove", 0), ("extract_links", 0),
    ("extract_downloads", 0), ("normalize_lines", 0), ("ads_per_file", 1), ("confusion_matrix", 1), ("build_dataset", 1),
])
def test_shuffles(spark, name, shuffles):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= shuffles and "RoundRobin" not in plan, plan[:3000]


def test_scan_reads_only_what_is_used(spark):
    plan = entry.queries()["doc_ads"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
