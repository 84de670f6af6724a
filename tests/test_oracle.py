"""Every registered query equals its SQL in DuckDB. TEST_SF picks the scale."""

import os

import pytest

from abstracta.catalog import ORACLES, QUERIES
from oracle import connect, difference

SF_DIR = f"/root/testdata/sf{os.environ.get('TEST_SF', '0.001')}"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    assert difference(QUERIES[key](spark, SF_DIR), duck, ORACLES[key]) is None
