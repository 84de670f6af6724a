"""Numbering, ranking, top-k and paging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def topk_search(vectors: DataFrame, k: int, distance: Column, *ties: str) -> DataFrame:
    """The ``k`` nearest rows, ascending; plans as ``TakeOrderedAndProject``."""
    scored = vectors.withColumn("distance", distance)
    return scored.orderBy("distance", *ties).limit(int(k))


def topk_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """First ``k`` rows per key with their 1-based ``rank``.

    Spark plans a group limit before and after the exchange, so every task sends at most
    ``k`` rows per key however many rows the key holds. It does so up to a threshold of
    its own; for a larger ``k`` a key's rows are ranked in parts first, which splits hot keys.
    """
    limit = int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if int(k) > limit:
        parts = Window.partitionBy(*keys, F.pmod(F.spark_partition_id(), F.lit(64))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= int(k)).drop("rank")
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= int(k))


def dedup_first_seen(rows: DataFrame, key: Column | str, position: Column | str) -> DataFrame:
    """Keep the row with the lowest position per key; the same group limit makes hot keys cheap."""
    window = Window.partitionBy(key).orderBy(position)
    return rows.withColumn("_seen", F.row_number().over(window)).where("_seen = 1").drop("_seen")


def dense_position(
    rows: DataFrame, position: str, name: str = "pos", start: int = 0, keys: Sequence[str] = (),
    width: int = 1_000_000,
) -> DataFrame:
    """Number rows ``start, start+1, ...`` (per key) in the order of a unique BIGINT column.

    One window over all rows would pass them through one task. Here rows are numbered
    inside ranges of ``width`` consecutive positions, which hold at most ``width`` rows
    because positions are unique, and shifted by the row count of the ranges before. Where
    positions lie so far apart that there may be over ``width`` ranges, their counts are
    summed in ranges of ranges in the same way.
    """
    span = F.floor(F.col(position) / F.lit(width)).cast("bigint")
    by_range = [*keys, "_range"]
    counts = rows.select(*keys, span.alias("_range")).groupBy(*by_range).agg(F.count("*").alias("_rows"))
    low, high = rows.agg(F.min(position), F.max(position)).head()
    ranges = 0 if low is None else high // width - low // width + 1
    offsets = _rows_before(counts, keys, width, ranges)
    inside = F.row_number().over(Window.partitionBy(*by_range).orderBy(position))
    numbered = rows.withColumn("_range", span).withColumn("_inside", inside)
    found = offsets.select(*[F.col(key).alias(f"_at_{key}") for key in by_range], "_before")
    same = [F.col(key).eqNullSafe(F.col(f"_at_{key}")) for key in by_range]
    return (
        numbered.join(found, reduce(lambda a, b: a & b, same))
        .withColumn(name, F.col("_before") + F.col("_inside") - 1 + F.lit(start))
        .drop("_inside", "_before", "_range", *[f"_at_{key}" for key in by_range])
    )


def _rows_before(counts: DataFrame, keys: Sequence[str], width: int, ranges: int) -> DataFrame:
    """``_before``: the rows in all lower ranges of the key; no window holds over ``width`` ranges."""
    upper = [F.floor(F.col("_range") / F.lit(width)).cast("bigint").alias("_upper")] if ranges > width else []
    counts = counts.select(*keys, *upper, "_range", "_rows")
    parts = [*keys, *(["_upper"] if upper else [])]
    lower = Window.partitionBy(*parts).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(lower), F.lit(0)))
    if upper:
        above = counts.groupBy(*parts).agg(F.sum("_rows").alias("_rows")).withColumnRenamed("_upper", "_range")
        above = _rows_before(above, keys, width, ranges // width + 2)
        above = above.select(*[F.col(c).alias(f"_up{c}") for c in [*keys, "_range"]], F.col("_before").alias("_more"))
        same = [F.col(key).eqNullSafe(F.col(f"_up{key}")) for key in keys] + [F.col("_upper") == F.col("_up_range")]
        counts = counts.join(above, reduce(lambda a, b: a & b, same)).withColumn("_before", F.col("_before") + F.col("_more"))
    return counts.select(*keys, "_range", "_before")


def assign_ids(rows: DataFrame, position: str, name: str = "id") -> DataFrame:
    """Id = position among the rows, as text."""
    return dense_position(rows, position, name).withColumn(name, F.col(name).cast("string"))


def paginate(
    results: DataFrame, page: int, per_page: int = 10, keys: Sequence[str] = ("query_id",), rank: str = "rank"
) -> DataFrame:
    """One page of each ranked list, with ``page`` clamped to ``[1, total_pages]``.

    The rank came from a window over the same keys, so the largest rank is one more window
    on rows that already lie together: no join, and a NULL key is a list like any other.
    """
    last = F.max(rank).over(Window.partitionBy(*keys))
    pages = (F.floor((last - 1) / F.lit(per_page)) + 1).cast("int")
    wanted = F.greatest(F.lit(1), F.least(F.lit(int(page)), F.col("total_pages")))
    paged = results.withColumn("total_pages", pages).withColumn("page", wanted)
    first = (F.col("page") - 1) * per_page
    return paged.where((F.col(rank) > first) & (F.col(rank) <= first + per_page))


def limit_first_n(rows: DataFrame, position: str, n: int) -> DataFrame:
    """The first ``n`` rows of a snapshot, by position."""
    return rows.orderBy(position).limit(int(n))
