"""Every query with SQL against DuckDB at scale factor 0.01."""

import os

import pytest
from oracle import check, duck

from tidemark import catalog

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    diff, _ = check(spark, con, FOLDER, name, catalog.queries()[name], SQL[name], rel=1e-9)
    assert diff == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalog.queries())
