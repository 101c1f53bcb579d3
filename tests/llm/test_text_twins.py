"""Queries of the text operators that have a SQL twin, on whole tables."""

import pytest

from fairlead.llm.queries import QUERIES, SQL
from tests.twins import database, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), database(SF_DIR), SQL[name]) is None
