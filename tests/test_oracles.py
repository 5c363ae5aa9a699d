"""Every registered query that SQL can express, against DuckDB on the same files."""

import pytest

import __spark_entry__ as entry
from manyvec.plans.catalog import ORACLES, QUERIES
from tests.comparing import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_contract_is_readable_without_a_session():
    import subprocess
    import sys

    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=entry.HERE).returncode == 0


def test_entry(spark):
    row = entry.entry(spark).collect()[0]
    assert row["n_queries"] == 26 and 0 < row["ndcg"] <= 1


def test_entry_survives_without_the_optional_parts(monkeypatch):
    import importlib

    real = importlib.import_module

    def without(name, *a):
        if name.startswith("manyvec.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", without)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
