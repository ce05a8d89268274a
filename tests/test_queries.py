"""Every registered query of the engine against its SQL."""

import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from tidemark.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, con, name):
    assert rows_of(QUERIES[name](spark, small)) == rows_of_sql(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_point(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["history_compare"](spark, small).count() > 0
