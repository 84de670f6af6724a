from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from abstracta.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", "tests")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Apply a column function to a list of values."""

    def run(inputs, function, dtype="string"):
        rows = spark.createDataFrame([(i, value) for i, value in enumerate(inputs)], f"i int, x {dtype}")
        result = rows.select("i", function(rows["x"]).alias("y")).orderBy("i").collect()
        return [row["y"] for row in result]

    return run
