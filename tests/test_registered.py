"""Every registered query beside its SQL."""

import pytest

import __spark_entry__ as entry

from .compare import compare
from .conftest import SF

QUERIES = entry.queries()
SQL = entry.oracle_sql()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered(spark, name):
    assert compare(spark, SF, name, QUERIES[name], SQL.get(name)) == ""


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10
