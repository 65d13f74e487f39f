"""Every query with a SQL twin gives the twin's rows; the others run and keep their invariants."""

import pytest
from compare import compare, connection

from orrery.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def connected(folder):
    return connection(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, folder, connected, name):
    assert compare(spark, folder, QUERIES[name], SQL[name], connected) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    assert rows
