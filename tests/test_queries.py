"""Named queries against their SQL statement on the smallest tables."""

import pytest

import __spark_entry__
from compare import compare, connect
from gradeloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: The training-data operators have tests of their own.
NAMES = sorted(name for name in __spark_entry__.queries() if name in QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    diff, _ = compare(spark, con, SF, __spark_entry__.queries()[name], __spark_entry__.oracle_sql().get(name))
    assert diff is None, diff


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
