"""Every registered query equals its SQL on the smallest tables."""
import pytest

import __spark_entry__ as contract
from check_oracles import compare, open_tables
from coldwatch.plans.queries import QUERIES
from oracles import ORACLES


@pytest.fixture(scope="module")
def con(small):
    return open_tables(small)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, small, name):
    assert compare(spark, con, name, contract.queries()[name], contract.oracle_sql()[name], small) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
