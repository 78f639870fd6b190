"""Every registered query: equal to its SQL at the smallest scale, or rows at least."""

from __future__ import annotations

import pytest
from conftest import SMALL
from oracle import compare, connect

import __spark_entry__ as contract

@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:2] == ["variable", "variable_type"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_equal_to_sql(spark, con, name):
    message = compare(contract.queries()[name](spark, SMALL), con, contract.oracle_sql()[name])
    assert message is None, message


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_has_rows(spark, name):
    assert contract.queries()[name](spark, SMALL).count() > 0
