"""Every registered query against DuckDB on the smallest tables."""

import pytest

from factloom.catalog import ORACLE_SQL, QUERIES

from .compare import connection, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE_SQL:
        assert difference(spark, con, QUERIES[name], ORACLE_SQL[name], SF) == ""
    else:
        assert QUERIES[name](spark, SF).columns
