"""Every registered query against its DuckDB oracle on sf0.001 (the driver's
gate runs the same comparison at sf0.01; tools/compare.py does it locally)."""

import pytest

import __spark_entry__ as E
from logloom.checks.registry import REGISTRY
from tools.compare import digest

from .conftest import SF_SMALL

# the optional subpackage has tests of its own
SQL = {name: sql for name, (_fn, sql) in REGISTRY.items() if sql is not None}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = REGISTRY[name][0](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(SQL[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(rel.columns, orows)


def test_every_query_has_an_oracle():
    assert set(REGISTRY) == set(SQL) and set(SQL) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["address", "blockHash", "blockNumber", "timestamp", "data", "logIndex",
                          "topics", "transactionHash", "transactionIndex"]
