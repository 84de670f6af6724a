"""Snapshots: JSON arrays for interchange, partitioned Parquet for work."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from abstracta.sources.json_arrays import read_json_arrays

PARTITIONS = ("venue", "year", "snapshot_ts")


def write_json_array(rows: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Write files that are each one pretty-enough JSON array, UTF-8 unescaped.

    A JSON array cannot be split by a reader, so files are kept to about ``rows_per_file``
    entries; brackets and commas are added while the rows stream by.
    """
    entries = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    files = max(1, -(-rows.count() // rows_per_file))

    def bracket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opening = "[\n"
        for batch in batches:
            if len(batch):
                lines = ",\n" + batch["value"]
                lines.iloc[0] = opening + batch["value"].iloc[0]
                opening = ",\n"
                yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["[]" if opening == "[\n" else "\n]"]})

    lines = entries.repartition(files).mapInPandas(bracket, "value string")
    lines.write.mode("errorifexists").option("lineSep", "\n").text(path)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType, splittable: bool = True) -> DataFrame:
    """Load JSON-array files with a given schema.

    The splittable form reads a file of any size in many tasks. The other leaves each file to
    one task, which suits many small files.
    """
    if splittable:
        return read_json_arrays(spark, path, schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_snapshot(rows: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS) -> None:
    """Add a snapshot to the table; the time stamp partition keeps re-harvests apart.

    The rebalance hint lets adaptive execution cut a venue that holds most rows into
    several tasks and merge small ones, so file sizes stay even.
    """
    rows.hint("rebalance", *partitions).write.mode("append").partitionBy(*partitions).parquet(path)


def latest_snapshot(table: DataFrame, keys: Sequence[str] = ("venue", "year")) -> DataFrame:
    """Rows of the newest snapshot per key."""
    newest = table.groupBy(*keys).agg(F.max("snapshot_ts").alias("snapshot_ts"))
    same = [table[key].eqNullSafe(newest[key]) for key in (*keys, "snapshot_ts")]
    return table.join(newest, reduce(lambda a, b: a & b, same), "left_semi")
