"""Every registered query of the core against its SQL."""

import pytest

from oracle import connect, rows, wanted
from strandline.plans import registry


@pytest.fixture(scope="module")
def db(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, data, db, name):
    assert rows(registry.QUERIES[name](spark, data)) == wanted(db, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, data, name):
    registry.QUERIES[name](spark, data).count()


def test_entry_module_lists_core_queries():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
