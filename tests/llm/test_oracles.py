"""Queries that SQL can express equal it; the others are held against brute force elsewhere."""

import os

import pytest

from abstracta.llm.queries import ORACLES, QUERIES
from oracle import connect, difference

SF_DIR = f"/root/testdata/sf{os.environ.get('TEST_SF', '0.001')}"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_sql(spark, key):
    assert difference(QUERIES[key](spark, SF_DIR), connect(SF_DIR), ORACLES[key]) is None


def test_every_operator_is_registered():
    assert [int(key.split("_")[0][2:]) for key in QUERIES] and {int(k.split("_")[0][2:]) for k in QUERIES} == set(range(1, 14))
