"""The driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from gleanery.plans import derived, oracle, queries, signals

SF = "/root/testdata/sf0.001"
FAST = ["cached_fetches", "answer_message", "answer_function", "answer_rpc", "bm25_corpus", "normalise_url", "page_links", "bm25_passages", *derived.NAMES, *signals.NAMES]
TABLES = ("documents", "pages", "conversations", "events", "orders", "customer", "supplier", "part", "benchmark")


def test_names():
    found = entry.queries()
    assert set(queries.NAMES) <= set(found)
    assert set(entry.oracle_sql()) <= set(found)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_against_duckdb(spark, name):
    matches(oracle.oracle_sql()[name], queries.queries()[name](spark, SF))


@pytest.mark.parametrize("name", queries.INLINE)
def test_inline_cases(spark, name):
    matches(oracle.inline_sql()[name], getattr(queries, name)(spark, SF))


def matches(sql, df):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = sorted(map(repr, cursor.fetchall()))
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == expected
