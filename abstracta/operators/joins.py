"""Source priority, unions and the equi joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from abstracta.functions.records import coalesce_title


def union_venues(snapshots: Sequence[DataFrame]) -> DataFrame:
    """Snapshots of several venues as one table; fields a snapshot lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), snapshots)


def first_nonempty_source(
    sources: Sequence[DataFrame], keys: Sequence[str] = ("venue", "year")
) -> DataFrame:
    """Per key, the rows of the first source that has any; adds the 0-based ``source_rank``.

    The winning source per key is a small aggregate joined back, so a key that holds a
    large share of the rows is not gathered anywhere.
    """
    tagged = union_venues([rows.withColumn("source_rank", F.lit(i)) for i, rows in enumerate(sources)])
    first = tagged.groupBy(*keys).agg(F.min("source_rank").alias("source_rank"))
    same = [tagged[key].eqNullSafe(first[key]) for key in (*keys, "source_rank")]
    return tagged.join(first, reduce(lambda a, b: a & b, same), "left_semi")


def list_detail_join(entries: DataFrame, details: DataFrame, key: str = "detail_url", order: str | None = None) -> DataFrame:
    """Look every list entry up in the detail rows; a failed lookup keeps the entry.

    A page crawled twice gives one detail row, the greatest by ``order`` or else by its
    fields, so no entry is multiplied. The detail title wins over the list title, and
    missing authors become an empty array.
    """
    fields = F.struct(*[F.col(c) for c in details.columns if c != key])
    by = F.struct(F.col(order), fields) if order else fields
    single = details.groupBy(key).agg(F.max_by(fields, by).alias("_fields")).select(key, "_fields.*")
    found = single.withColumnRenamed("title", "_detail_title")
    joined = entries.join(found, key, "left").withColumn(
        "title", coalesce_title(F.col("_detail_title"), F.col("title"))
    )
    if "authors" in details.columns:
        joined = joined.withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))
    return joined.drop("_detail_title")


def review_enrichment(
    papers: DataFrame, reviews: DataFrame, measures: Mapping[str, str], key: str = "id", forum_base: str | None = None
) -> DataFrame:
    """Attach review means per paper; ``measures`` maps a review column to its output name.

    Reviews are averaged before the join, so a paper with very many reviews is one row.
    """
    means = [F.avg(column).alias(name) for column, name in measures.items()]
    summary = reviews.groupBy(key).agg(F.count("*").alias("n_reviews"), *means)
    joined = papers.join(summary, key, "left").withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0)))
    if forum_base is not None:
        joined = joined.withColumn("forum", F.concat(F.lit(forum_base), F.col(key).cast("string")))
    return joined
