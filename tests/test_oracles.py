"""Every query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__
from checks import registry
from checks.compare import connect, differences


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, con, folder, name):
    assert differences(spark, con, folder, name) == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_each_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
