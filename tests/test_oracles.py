"""Every query that SQL can express returns what the SQL returns."""

import pytest

from loomtrace.queries import ORACLES, QUERIES
from tests.tables import SF_DIR, compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    compare(spark, duck, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
