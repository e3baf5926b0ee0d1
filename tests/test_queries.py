"""Every registered query that SQL can express, against DuckDB on the same tables; the others must give rows."""

import pytest
from oracle import database, difference

import __spark_entry__  # noqa: F401  (all modules of queries)
from mnemolith.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, con, name):
    assert difference(queries.QUERIES[name](spark, SF), con, queries.ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
