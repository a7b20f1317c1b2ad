"""Every registered query with SQL, against DuckDB on the same tables."""

import pytest
from compare import duck, duck_rows, spark_rows

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    got = spark_rows(QUERIES[name](spark, SF))
    if name in SQL:
        assert got == duck_rows(con, SQL[name])
    assert got[1]


def test_sql_is_for_known_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "target", "count"]
