"""Statistics kept current: partial counts of every load, merged when they are read.

A load leaves ``venue, year, snapshot_ts, decision, n`` in its own folder ``load=<id>``; a load
that runs again replaces it. A snapshot may come in several loads. Of a venue and year the
newest snapshot counts, so a re-harvest replaces the counts of the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

_KEYS = ("venue", "year")
COUNTS = T.StructType(
    [
        T.StructField("venue", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("snapshot_ts", T.TimestampType()),
        T.StructField("decision", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("load", T.StringType()),
    ]
)


def record_counts(rows: DataFrame, path: str, load: str) -> None:
    """Count the rows of a load (``venue, year, snapshot_ts, decision``); a given load replaces itself."""
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in COUNTS.fields[:4]]
    counted = rows.select(*typed).groupBy(*[f.name for f in COUNTS.fields[:4]]).agg(F.count("*").alias("n"))
    writer = counted.withColumn("load", F.lit(load)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("load").parquet(path)


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """``venue, year, decision, n`` of the newest snapshot of every venue and year."""
    parts = spark.read.schema(COUNTS).parquet(path)
    newest = parts.groupBy(*_KEYS).agg(F.max("snapshot_ts").alias("snapshot_ts"))
    same = [parts[key].eqNullSafe(newest[key]) for key in (*_KEYS, "snapshot_ts")]
    kept = parts.join(newest, reduce(lambda a, b: a & b, same), "left_semi")
    return kept.groupBy(*_KEYS, "decision").agg(F.sum("n").alias("n"))


def current_stats(spark: SparkSession, path: str, decisions: Sequence[str]) -> DataFrame:
    """Papers per venue, year and decision class, a column for each class and ``other``."""
    counts = current_counts(spark, path)
    listed = F.col("decision").isin(*decisions)
    columns = [F.coalesce(F.sum(F.when(F.col("decision") == d, F.col("n"))), F.lit(0)).alias(d) for d in decisions]
    other = F.coalesce(F.sum(F.when(listed, None).otherwise(F.col("n"))), F.lit(0)).alias("other")
    return counts.groupBy(*_KEYS).agg(*columns, other)


def current_totals(spark: SparkSession, path: str) -> DataFrame:
    """The counts with totals over classes, years and venues, and the grouping level."""
    counts = current_counts(spark, path)
    return counts.rollup(*_KEYS, "decision").agg(F.sum("n").alias("n"), F.grouping_id().cast("int").alias("level"))


def keep_counts(
    spark: SparkSession, source: str, schema: T.StructType, path: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Count every new Parquet file of harvests under ``source``, then stop.

    A micro-batch that is delivered twice writes the same folder again.
    """
    spark.createDataFrame([], COUNTS).write.mode("ignore").partitionBy("load").parquet(path)
    name = hashlib.md5(checkpoint.encode()).hexdigest()
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        arriving.writeStream.foreachBatch(lambda batch, number: record_counts(batch, path, f"{name}-{number}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
