"""Harvest pipelines: notes to papers, landed pages to records, newest snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from abstracta.catalog.cleaning import _PLACEHOLDERS
from abstracta.catalog.registry import PAPERS_SQL, SQL_SPACES, papers, registered
from abstracta.plans.harvest import harvest_proceedings, normalize_notes, notes_to_papers
from abstracta.schema import PDF_BASE, RENAMES_API
from abstracta.session import scratch_path
from abstracta.sources.snapshot import latest_snapshot, write_snapshot


def _wrapped(value: Column) -> Column:
    return F.to_json(F.struct(value.alias("value")), {"ignoreNullFields": "false"})


@registered("harvest_notes", f"""
WITH {PAPERS_SQL}, named AS (SELECT *, {_PLACEHOLDERS} AS shown FROM papers)
SELECT doc_id, shown AS title, abstract, array_to_string([lang, venue], '|') AS keywords,
       CASE WHEN lang = 'de' THEN 2 ELSE 0 END AS n_authors, venue, year,
       '{PDF_BASE}pdf/' || id || '.pdf' AS link, venue_text AS tldr
FROM named WHERE shown IS NULL OR NOT regexp_full_match(shown, 'Null[^\\s]+')
""".replace("\\\\", "\\"))
def harvest_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir, heavy=True).withColumn("shown", F.expr(_PLACEHOLDERS))
    fields = {
        "title": _wrapped(F.col("shown")),
        "abstract": _wrapped(F.col("abstract")),
        "keywords": _wrapped(F.array("lang", "venue")),
        "authors": F.when(F.col("lang") == "de", _wrapped(F.array("id", "venue"))),
        "venue": _wrapped(F.col("venue")),
        "pdf": _wrapped(F.concat(F.lit("/pdf/"), "id", F.lit(".pdf"))),
        "tldr": F.col("venue_text"),
    }
    content = F.map_filter(F.create_map(*[c for k, v in fields.items() for c in (F.lit(k), v)]), lambda _k, v: v.isNotNull())
    notes = rows.select("doc_id", F.col("year").alias("of"), content.alias("content"))
    found = notes_to_papers(
        normalize_notes(notes, renames=RENAMES_API), F.lit(None).cast("string"), F.col("of"), F.lit("Submitted")
    )
    return found.select(
        "doc_id", "title", "abstract", F.array_join("keywords", "|").alias("keywords"),
        F.size("authors").alias("n_authors"), "venue", "year", "link", F.col("extra")["tldr"].alias("tldr"),
    )


_SITE = "https://proceedings.example.org"


@registered("harvest_proceedings", f"""
WITH {PAPERS_SQL}, named AS (
  SELECT *, CASE WHEN doc_id % 50 = 0 THEN 'Null' || venue WHEN lang = 'fr' THEN 'Listed ' || id ELSE 'Paper ' || id END AS shown FROM papers)
SELECT '{_SITE}/c/' || id || '.html' AS link, shown AS title,
       CASE WHEN lang <> 'fr' THEN venue || ' ' || trim(abstract, {SQL_SPACES}) END AS abstract,
       CASE WHEN lang <> 'fr' THEN 'A ' || lang || '|B ' || venue ELSE '' END AS authors,
       CASE WHEN lang <> 'fr' THEN '@m{{' || id || '}}' END AS bibtex,
       CASE WHEN lang <> 'fr' THEN '{_SITE}/bib/' || id || '.bib' END AS bibtex_url, 'CVPR' AS conference, 2024 AS year
FROM named WHERE doc_id % 50 <> 0
""")
def harvest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages name every paper twice; papers in one language have no detail page."""
    rows = papers(spark, sf_dir, heavy=True).withColumn("path", F.format_string("/c/%s.html", "id"))
    null = F.col("doc_id") % 50 == 0
    listed = F.when(null, F.concat(F.lit("Null"), "venue")).otherwise(F.concat(F.lit("Listed "), "id"))
    lists = rows.select(
        F.col("doc_id").alias("page_id"),
        F.concat(
            F.lit('<dt class="ptitle"><br><a href="'), "path", F.lit('">'), listed, F.lit('</a></dt><dt class="ptitle"><a href="'),
            "path", F.lit('">Again</a></dt>'),
        ).alias("html"),
    )
    text = F.replace(F.replace(F.col("abstract"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    title = F.when(null, F.concat(F.lit("Null"), "venue")).otherwise(F.concat(F.lit("Paper <i>"), "id", F.lit("</i>")))
    details = rows.where("lang <> 'fr'").select(
        F.concat(F.lit(_SITE), "path").alias("url"),
        F.concat(
            F.lit('<div id="papertitle">'), title, F.lit('</div><div id="authors"><b><i>A '), "lang", F.lit(",  B "), "venue",
            F.lit(',</i></b></div><div id="abstract"><div>'), "venue", F.lit("</div> "), text,
            F.lit('</div><a href="../bib/'), "id", F.lit('.bib">[BibTeX]</a><div class="bibref"><pre>\n@m{'), "id", F.lit("}\n</pre></div>"),
        ).alias("html"),
    )
    found = harvest_proceedings(lists, details, "cvpr", 2024, F.lit(_SITE))
    return found.select(
        "link", "title", "abstract", F.array_join("authors", "|").alias("authors"),
        F.col("_bibtex").alias("bibtex"), "bibtex_url", "conference", "year",
    )


@registered("latest_snapshot", f"""
WITH {PAPERS_SQL}, landed AS (
  SELECT doc_id, title, venue, year, 1 AS harvest FROM papers
  UNION ALL SELECT doc_id, title, venue, year, 2 FROM papers WHERE lang IN ('de', 'fr') AND year <> 2023)
SELECT doc_id, title, venue, year, harvest FROM landed
QUALIFY harvest = max(harvest) OVER (PARTITION BY venue, year)
""")
def newest_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir).select("doc_id", "title", "lang", "venue", "year")
    path = scratch_path(spark, "harvests")
    for number, harvest in enumerate((rows, rows.where("lang IN ('de', 'fr') AND year <> 2023")), 1):
        stamp = F.to_timestamp(F.lit(f"2026-01-0{number} 00:00:00"))
        stamped = harvest.drop("lang").withColumn("snapshot_ts", stamp)
        write_snapshot(stamped, path)
    landed = spark.read.schema(T.StructType(stamped.schema.fields)).parquet(path)
    return latest_snapshot(landed).select("doc_id", "title", "venue", "year", F.dayofmonth("snapshot_ts").alias("harvest"))
