"""Every query with an oracle gives its rows; every query runs."""

import importlib

import pytest
from helpers import as_rows

import __spark_entry__ as entry

MODULES = [importlib.import_module(m) for m in entry.CORE]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in getattr(m, "ORACLES", {}).items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    got = as_rows(df.columns, df.collect())
    rel = duck.sql(ORACLES[name])
    assert got == as_rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
