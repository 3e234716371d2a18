"""Every registered query that SQL can state agrees with its SQL exactly."""

import compare
import pytest

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, small, con, name):
    assert compare.difference(contract.queries()[name](spark, small), con, contract.oracle_sql()[name]) is None


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
