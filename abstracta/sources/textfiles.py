"""Ordered text output and the dash-separated export format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Five or more dashes end an entry; what we write between entries.
SEPARATOR = r"-{5,}"
RULE = "-" * 80


def write_ordered_text(
    rows: DataFrame, value: str, order: Sequence[str], path: str, rows_per_file: int = 100_000,
    n_rows: int | None = None,
) -> None:
    """Write one text value per row; the part files in name order are in row order.

    Ranges of the order go to separate tasks, so no task holds the whole output. Small
    outputs are one file. ``n_rows`` saves the count where it is known.
    """
    files = max(1, -(-(rows.count() if n_rows is None else n_rows) // rows_per_file))
    ranged = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ranged.select(value).write.mode("errorifexists").option("lineSep", "\n").text(path)


def read_export_blocks(spark: SparkSession, path: str, splittable: bool = True) -> DataFrame:
    """Non-empty entries of export files: ``file, pos, value`` in file order.

    The splittable form cuts at every five dashes while reading, so one large file is read
    by many tasks; the rest of a longer run of dashes is then in front of the next piece
    and is removed there. The other form reads each file as one value.
    """
    if not splittable:
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        pieces = whole.select(
            "file", F.posexplode(F.filter(F.split("value", SEPARATOR), lambda p: p != "")).alias("pos", "value")
        )
        return pieces.withColumn("pos", F.col("pos").cast("bigint"))
    pieces = spark.read.option("lineSep", "-----").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        # Rises with the row inside a split; splits are told apart by their start.
        F.monotonically_increasing_id().alias("_seq"),
        "value",
    )
    # The first piece of a file has no separator before it, so its dashes are its own.
    by_split = Window.partitionBy("file", "_block").orderBy("_seq")
    leading = (F.col("_block") == 0) & (F.row_number().over(by_split) == 1)
    rest = F.regexp_replace("value", r"\A-{1,4}", "")
    pieces = pieces.withColumn("_leads", leading).withColumn("value", F.when(F.col("_leads"), F.col("value")).otherwise(rest))
    kept = pieces.where("value <> ''").drop("_leads")
    # Entries are numbered inside their split, which is bounded in bytes, and shifted by
    # the entries of the file's earlier splits.
    splits = kept.groupBy("file", "_block").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(by_split)
    return kept.withColumn("_inside", inside).join(starts, ["file", "_block"]).select(
        "file", (F.col("_before") + F.col("_inside") - 1).alias("pos"), "value"
    )


def export_block(title: Column, venue: Column, link: Column, score: Column, bibtex: Column) -> Column:
    """One result as the text block that the export tools read back."""
    missing = F.lit("")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), F.coalesce(title, missing)),
        F.concat(F.lit("Venue: "), F.coalesce(venue, missing)),
        F.concat(F.lit("Link: "), F.coalesce(link, missing)),
        F.concat(F.lit("Affinity Score: "), F.format_string("%.4f", F.round(score, 4))),
        F.lit("BibTeX:"),
        F.coalesce(bibtex, missing),
    )


def write_export(results: DataFrame, path: str, order: Sequence[str] = ("query_id", "rank")) -> None:
    """Write result blocks in order, a line of dashes after each."""
    lines = results.withColumn("_value", F.concat_ws("\n", F.col("block"), F.lit(RULE)))
    write_ordered_text(lines, "_value", order, path)
