"""Every registered query returns exactly the rows of its SQL twin."""

import pytest

from __spark_entry__ import entry
from catalog.oracle import twins as oracle_sql
from catalog.queries import registry as queries
from tests.compare import differences, duckdb_views

@pytest.fixture(scope="module")
def connection(folder):
    return duckdb_views(folder)


def test_every_query_has_a_twin():
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(queries()))
def test_equals_sql(spark, folder, connection, name):
    rows, extra, missing = differences(queries()[name](spark, folder), connection, oracle_sql()[name])
    assert rows > 0
    assert (list(extra)[:3], list(missing)[:3]) == ([], [])
