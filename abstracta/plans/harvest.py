"""Raw notes and landed pages to cleaned records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from abstracta.functions.records import normalize_pdf_url, rename_keys, unwrap_content
from abstracta.functions.text import parse_keywords
from abstracta.operators.clean import drop_placeholder_titles, drop_short_titles, rename_fields, tag_source
from abstracta.operators.joins import list_detail_join
from abstracta.operators.ranking import dedup_first_seen
from abstracta.schema import PDF_BASE, RENAMES_CRAWL
from abstracta.sources.pages import explode_links, extract_details, list_links


def normalize_notes(
    notes: DataFrame, *, renames: Mapping[str, str] | None = None, pdf_base: str = PDF_BASE,
    shortest_title: int = 0, content: str = "content",
) -> DataFrame:
    """Unwrap, filter and rename raw notes whose content is a map of JSON texts.

    The variants of the normaliser are parameters: ``shortest_title=5`` also drops short
    and missing titles, ``renames`` gives the output names.
    """
    plain = notes.withColumn(content, unwrap_content(F.col(content)))
    kept = drop_placeholder_titles(plain, F.col(content)["title"])
    if shortest_title:
        kept = drop_short_titles(kept, F.col(content)["title"], shortest_title)
    linked = F.transform_values(
        content, lambda key, value: F.when(key == "pdf", normalize_pdf_url(value, pdf_base)).otherwise(value)
    )
    return kept.withColumn(content, rename_keys(linked, renames or {}))


def notes_to_papers(notes: DataFrame, venue: Column, year: Column, state: Column, content: str = "content") -> DataFrame:
    """Flat entries as canonical columns; unknown keys go to ``extra``."""
    entry = F.col(content)
    known = ["title", "abstract", "authors", "keywords", "venue", "link", "pdf", "_bibtex"]
    return notes.select(
        *[c for c in notes.columns if c != content],
        entry["title"].alias("title"),
        entry["abstract"].alias("abstract"),
        F.coalesce(parse_keywords(entry["authors"]), F.array().cast("array<string>")).alias("authors"),
        parse_keywords(entry["keywords"]).alias("keywords"),
        F.coalesce(venue, entry["venue"]).alias("venue"),
        year.cast("string").try_cast("int").alias("year"),
        state.alias("state"),
        F.coalesce(entry["link"], entry["pdf"]).alias("link"),
        entry["_bibtex"].alias("bibtex"),
        F.map_filter(entry, lambda key, _value: ~key.isin(*known)).alias("extra"),
    )


def harvest_proceedings(
    list_pages: DataFrame, detail_pages: DataFrame, conference: str, year: int, base: Column,
    list_order: str = "page_id",
) -> DataFrame:
    """List and detail pages of one conference to cleaned records with their output names."""
    entries = explode_links(list_pages, list_links(F.col("html")), base, list_order, escaped=False)
    # Repeated links are dropped before the join, the costly step.
    first = dedup_first_seen(entries, "detail_url", F.struct(list_order, "pos")).drop("pos", list_order)
    records = list_detail_join(first, extract_details(detail_pages))
    tagged = tag_source(records, conference, year).withColumnRenamed("venue", "conference")
    renamed = {**RENAMES_CRAWL}
    return rename_fields(drop_placeholder_titles(tagged), renamed)
