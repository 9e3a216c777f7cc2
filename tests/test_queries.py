"""Every core query against its SQL, over whole tables."""

from __future__ import annotations

import oracle
import pytest

from spanloom import catalog


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    oracle.assert_same(catalog.queries()[name](spark, oracle.SF_DIR), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted({*catalog.queries()} - {*catalog.oracle_sql()}))
def test_query_without_sql_runs(spark, name):
    catalog.queries()[name](spark, oracle.SF_DIR).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == catalog.queries()["lang_profile"](spark, oracle.SF_DIR).columns
    assert {*catalog.queries()} <= {*__spark_entry__.queries()}
