"""The queries of this subpackage that SQL can express return what the SQL returns."""

import pytest

from loomtrace.llm.queries import ORACLES, QUERIES
from tests.tables import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    compare(spark, duck, QUERIES[name], ORACLES[name])
