"""Counts over raw notes and over the corpus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def attribute_census(notes: DataFrame, content: str = "content") -> DataFrame:
    """How many notes carry each attribute of a map column."""
    return (
        notes.select(F.explode(F.map_keys(content)).alias("attribute"))
        .groupBy("attribute")
        .agg(F.count("*").alias("n"))
    )


def column_census(rows: DataFrame) -> DataFrame:
    """The same for a fixed schema: non-NULL values per column, in one pass."""
    counts = rows.agg(*[F.count(c).alias(c) for c in rows.columns])
    return counts.unpivot([], counts.columns, "attribute", "n")


def stage_counts(rows: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows in total and rows that pass each named condition, in one pass."""
    return rows.agg(
        F.count("*").alias("n_total"), *[F.count_if(condition).alias(name) for name, condition in stages.items()]
    )


def venue_year_stats(
    rows: DataFrame, classes: Sequence[str], column: str = "decision", keys: Sequence[str] = ("venue", "year")
) -> DataFrame:
    """Papers per key and class with 0 for none; ``other`` counts every class not given.

    The classes are given, so no extra pass looks for them.
    """
    listed = F.coalesce(F.col(column).isin(list(classes)), F.lit(False))
    counts = [F.count_if(F.col(column) == name).alias(name) for name in classes]
    return rows.groupBy(*keys).agg(*counts, F.count_if(~listed).alias("other"))


def venue_year_totals(rows: DataFrame, keys: Sequence[str] = ("venue", "year", "decision")) -> DataFrame:
    """Counts with subtotals; ``level`` is the grouping id (0 = finest)."""
    return rows.rollup(*keys).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))
