"""Every registered query against its SQL twin, on whole tables."""

import pytest

from fairlead.plans.registry import load
from tests.twins import database, difference

SF_DIR = "/root/testdata/sf0.001"
CATALOG = load()
# Queries that SQL cannot express.
WITHOUT_TWIN: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql])
def test_same_as_sql(spark, con, name):
    query = CATALOG[name]
    assert difference(query.build(spark, SF_DIR), con, query.sql) is None


@pytest.mark.parametrize("name", sorted(WITHOUT_TWIN))
def test_runs(spark, name):
    assert CATALOG[name].build(spark, SF_DIR).count() > 0


def test_only_known_queries_lack_a_twin():
    assert {n for n, q in CATALOG.items() if not q.sql} == WITHOUT_TWIN


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "seq"
    assert set(entry.oracle_sql()) <= set(entry.queries())
