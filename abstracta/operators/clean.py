"""Record cleaning: filters, renames, defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from abstracta.functions.text import is_placeholder_title, strip_text


def drop_placeholder_titles(rows: DataFrame, title: str | Column = "title") -> DataFrame:
    """Drop rows whose whole title is ``Null`` plus one word; a missing title stays."""
    column = F.col(title) if isinstance(title, str) else title
    return rows.where(~is_placeholder_title(column))


def drop_short_titles(rows: DataFrame, title: str | Column = "title", shortest: int = 5) -> DataFrame:
    """Drop titles under ``shortest`` characters; a missing title counts as empty."""
    column = F.col(title) if isinstance(title, str) else title
    return rows.where(F.length(F.coalesce(column, F.lit(""))) >= shortest)


def accepted_only(rows: DataFrame, venue_text: str, conference: str, state: str) -> DataFrame:
    """Accepted papers of the one conference that lists submissions with them.

    Acts for state ``Accepted`` and conference ``ICLR`` only; a NULL venue text is dropped.
    """
    if state == "Accepted" and conference == "ICLR":
        return rows.where(~F.contains(F.col(venue_text), F.lit("Submi")))
    return rows


def venue_year_filter(rows: DataFrame, venues: Sequence[str], years: Sequence[int]) -> DataFrame:
    """Rows of any chosen venue and year; both are partition columns of a stored snapshot."""
    return rows.where(F.col("venue").isin(*venues) & F.col("year").isin(*years))


def language_filter(rows: DataFrame, langs: Sequence[str] = ()) -> DataFrame:
    """Rows in the chosen languages; no choice means all."""
    return rows.where(F.col("lang").isin(*langs)) if langs else rows


def require_query_text(queries: DataFrame, text: str = "text") -> DataFrame:
    """Add ``error``: the message for a blank query, NULL for one that can be searched."""
    blank = F.coalesce(strip_text(F.col(text)), F.lit("")) == ""
    return queries.withColumn("error", F.when(blank, F.lit("Please enter a query.")))


def rename_fields(rows: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    return rows.withColumnsRenamed(dict(renames))


def tag_source(rows: DataFrame, conference: str, year: int) -> DataFrame:
    """Add the upper-cased, stripped conference name and the year."""
    return rows.withColumns(
        {"venue": F.upper(strip_text(F.lit(conference))), "year": F.lit(int(year))}
    )


def split_metadata(rows: DataFrame, document: str = "abstract") -> DataFrame:
    """``document`` (missing gives ``''``) and ``metadata``: every other field as text."""
    others = [c for c in rows.columns if c != document]
    pairs = [part for c in others for part in (F.lit(c), F.col(c).cast("string"))]
    metadata = F.map_filter(F.create_map(*pairs), lambda _key, value: value.isNotNull())
    return rows.select(F.coalesce(document, F.lit("")).alias("document"), metadata.alias("metadata"))


def fill_defaults(rows: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Replace absent fields; a default of a column the rows lack adds the column."""
    return rows.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value)
            for name, value in defaults.items()
        }
    )
