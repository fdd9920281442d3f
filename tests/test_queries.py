"""Every registered query of the library's own operators against its SQL."""

import pytest

from countspark.plans import queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, db, name):
    assert compare(spark, db, SF, queries.queries()[name], queries.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
