"""Every query of the library against its SQL."""

import pytest

from millrace import queries as core

from .oracle import connection, difference


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert difference(core.queries()[name](spark, sf_dir), con, core.oracle_sql()[name]) == ""


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
