"""Every query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import pytest
from comparing import differences, duckdb_tables

import __spark_entry__ as driver
from loglens.plans import catalog, oracle

ORACLE = oracle.oracle_sql()


@pytest.fixture(scope="module")
def tables(sf_dir):
    return duckdb_tables(sf_dir)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(ORACLE)
    assert set(ORACLE) <= set(driver.queries())


def test_entry_gives_rows(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_matches_oracle(spark, sf_dir, tables, name):
    assert differences(catalog.queries()[name](spark, sf_dir), tables, ORACLE[name]) is None
