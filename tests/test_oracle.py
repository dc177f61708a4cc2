"""Registered queries against their SQL on the smallest tables."""

import pytest

from checks.compare import compare, connect
from checks.oracle import oracle
from checks.queries import registry


def test_every_query_has_sql():
    assert set(registry()) == set(oracle())


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry()))
def test_same_rows(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir) == ""
