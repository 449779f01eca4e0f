"""Every registered query with SQL equals DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as registry
from tests.conftest import SMALL
from tools.check_queries import TABLES, rows_of

# Queries with many full model fits; tools/check_queries.py runs them.
LONG_FITS = ("M5_", "M6_", "M9_fitted", "M13_", "M16_", "M17_", "M18_", "M21_", "M25_")
ORACLES = {k: v for k, v in registry.oracle_sql().items() if not k.startswith(LONG_FITS)}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    result = registry.queries()[name](spark, SMALL)
    names, got = rows_of(result.columns, result.collect())
    cursor = duck.execute(ORACLES[name])
    wanted_names, wanted = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert names == wanted_names
    assert got == wanted


def test_entry_runs(spark):
    assert registry.entry(spark).count() > 0
