"""The entry module: names, SQL for registered queries only, and queries that match DuckDB on the smallest data."""

import importlib
import sys

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
CHECKED = ["url_canonical", "url_kind_counts", "page_slug", "body_normalised_hash", "fact_count", "status_pivot", "page_inventory"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_package(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("pagewright.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("pagewright.llm", "corpus_pipeline")) else real(name, *a))
    assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"] and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("pages", "documents", "labels"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    got = entry.queries()[name](spark, SMALL)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
