"""Every registered query with SQL gives the same columns, types and rows as DuckDB."""

import pytest

import __spark_entry__ as driver
from tests.compare import connect, differences, duckdb_result, spark_result
from tests.plans import plan_of
from tripwise import catalog

SF_DIR = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()
QUERIES = driver.queries()


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


def test_every_sql_text_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ORACLES)
def test_same_result_as_duckdb(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    assert differences(spark_result(df), duckdb_result(tables, ORACLES[name])) == ""
    plan = plan_of(df)
    assert not [node for node in ("Python", "CartesianProduct", "NestedLoopJoin") if node in plan]


def test_entry_gives_one_row_per_hour(spark):
    rows = driver.entry(spark).collect()
    assert [r["pickup_hour"] for r in rows] == sorted({r["pickup_hour"] for r in rows})
    assert 0 < len(rows) <= 24
