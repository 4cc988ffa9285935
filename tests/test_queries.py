"""Every query of the engine's own operators against its SQL."""

import pytest

from tests.conftest import SF
from tests.oracle import compare, connection
from verdigris.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def db():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    assert compare(QUERIES[name](spark, SF), SQL[name], db) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
