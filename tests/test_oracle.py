"""Every registered query against its DuckDB oracle at sf0.01 (the
driver's correctness gate), and the flagship smoke run at sf0.001."""

import re

import pytest

import __spark_entry__ as entry_module
from tierloom import registry
from tierloom.plans import bronze, gold, silver
from tierloom.sources import fixtures as landing_writer
from tierloom.sources import layers
from plan_text import physical_plan
from compare import compare, duckdb_views
from conftest import SF001, SF01
from tierloom.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck():
    return duckdb_views(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry_module.queries())


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["customer_id", "total_sales"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = entry_module.queries()[name](spark, SF01)
    assert compare(df, duck, entry_module.oracle_sql()[name]) == []


def test_oracles_read_whole_tables():
    for name, sql in ORACLE_SQL.items():
        assert not re.search(r"(?i)\bLIMIT\b|\bSAMPLE\b|%|\bMOD\s*\(", sql), name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_read_whole_tables(spark, name, monkeypatch):
    """No plan that makes a query's data, written ones included, caps,
    samples or subsets its input, or drops a row of a table."""
    plans = []
    for module in (landing_writer, layers):
        for writer in ("land_csv", "write_layer", "write_table"):
            if hasattr(module, writer):
                real = getattr(module, writer)
                noted = lambda df, *args, real=real, **kw: (plans.append(df), real(df, *args, **kw))[1]
                for user in (registry, bronze, silver, gold):
                    if hasattr(user, writer):
                        monkeypatch.setattr(user, writer, noted)
    plans.append(QUERIES[name](spark, SF001))
    text = "\n".join(physical_plan(df) for df in plans)
    assert not re.search(r"(Global|Local|Collect)Limit|\bSample\b|TakeOrdered", text), name
    assert "lineitem.parquet" in text, name
    filters = re.findall(r"DataFilters: \[([^\]]*)\]", text)
    assert all(re.fullmatch(r"(isnotnull\(\w+#\d+L?\)(, )?)*", f) for f in filters), (name, filters)
