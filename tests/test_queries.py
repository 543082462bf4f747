"""Registered queries against their SQL on the smallest scale."""

from pathlib import Path

import pytest

import oracle_check

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return oracle_check.connect(SF_DIR)


def names():
    from flowmark.plans.catalog import QUERIES

    return list(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, connection, name):
    from flowmark.plans.oracles import ORACLES

    status, _, _ = oracle_check.compare(spark, connection, name, SF_DIR)
    # those without SQL have their values checked by entries of their own or by other tests
    assert status == ("ok" if name in ORACLES else "rows-only")


def test_every_oracle_has_a_query():
    from flowmark.plans.catalog import QUERIES
    from flowmark.plans.oracles import ORACLES

    assert ORACLES.keys() <= QUERIES.keys()
