"""Registered queries against DuckDB, and what all of them must hold."""

import re

import pytest
from llm_helpers import SF01

import __spark_entry__ as entry_module
from compare import compare, duckdb_views
from tierloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_duckdb(spark, name):
    assert compare(registry.QUERIES[name](spark, SF01), duckdb_views(SF01), registry.ORACLE_SQL[name]) == []


def test_one_query_for_each_operator_and_the_pipeline():
    found = {int(m[1]) for q in entry_module.queries() if (m := re.match(r"op(\d+)_", q))}
    assert found == set(range(1, 14))
    assert "pipeline" in entry_module.queries()


def test_no_sampling_in_the_oracles():
    for name, sql in registry.ORACLE_SQL.items():
        assert not re.search(r"(?i)\bLIMIT\b|\bSAMPLE\b", sql), name


def test_nothing_else_imports_the_package():
    import pathlib

    root = pathlib.Path(entry_module.__file__).parent
    for path in (root / "tierloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(import|from)\s.*\bllm\b", path.read_text()), path
