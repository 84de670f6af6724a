from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, repeated rows and ids, clashing columns."""
    passage = " ".join(f"common{i} passage" for i in range(40))
    rows = [
        (1, passage, "s", 1),
        (2, f"before {passage} after", "s", 2),
        (2, f"before {passage} after", "s", 2),
        (2, "another text of the same id", None, None),
        (3, None, None, 3),
        (4, "", "t", 4),
        (5, "  \n\t ", "t", 5),
        (None, f"no id {passage}", "t", 6),
        (None, None, "t", 7),
        (6, "é" * 3000 + " long " * 40_000, "s", 8),
        (7, "q" * 700, "s", 9),
        (8, "under the MIT license. Licensed under the Apache License, Version 2.0", "u", 10),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    clash = {c: "x" for c in ("doc", "copy", "fp", "key", "size", "count", "kmer", "score", "position", "rest", "id")}
    from pyspark.sql import functions as F

    return frame.withColumns({"lang": F.lit("en"), **{c: F.lit(v) for c, v in clash.items()}})
