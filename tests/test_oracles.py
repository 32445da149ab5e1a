"""Every registered query against its oracle on the smallest tables."""

import pytest

import __spark_entry__ as contract
from millrace.plans import QUERIES as OWN
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {key: contract.queries()[key] for key in OWN}
ORACLES = {key: sql for key, sql in contract.oracle_sql().items() if key in OWN}


@pytest.fixture(scope="module")
def duck():
    with connect(SF_DIR) as con:
        yield con


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, duck, key):
    assert differences(QUERIES[key](spark, SF_DIR), ORACLES[key], duck) == []


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, key):
    assert QUERIES[key](spark, SF_DIR).count() > 0


def test_entry_returns_ten_rows(spark):
    assert len(contract.entry(spark).collect()) == 10
