"""The registered queries against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from harvestry import registry


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_packages(monkeypatch):
    """If the optional operators can't be imported, the library's own queries are there."""
    import sys

    monkeypatch.setitem(sys.modules, "xxhash", None)
    for name in [m for m in sys.modules if m.startswith("harvestry.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.SQL) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(registry.SQL[name]).df()
    assert sorted(want.columns) == columns
    rows = lambda df: sorted(df[columns].astype(str).values.tolist())
    assert rows(got.toPandas()) == rows(want)
