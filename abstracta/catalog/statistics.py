"""Counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from abstracta.catalog.registry import PAPERS_SQL, papers, registered
from abstracta.functions.records import DECISIONS, decision_class
from abstracta.functions.text import is_placeholder_title
from abstracta.operators import stats
from abstracta.session import scratch_path, table
from abstracta.streaming import counts


@registered("attribute_census", """
SELECT attribute, count(*) AS n FROM (
  SELECT unnest(json_keys(props)) AS attribute FROM events
  UNION ALL SELECT 'event_type' FROM events WHERE event_type IS NOT NULL
  UNION ALL SELECT 'value' FROM events WHERE value > 10) GROUP BY attribute
""")
def attribute_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    fixed = F.create_map(
        F.lit("event_type"), F.col("event_type"),
        F.lit("value"), F.when(F.col("value") > 10, F.col("value").cast("string")),
    )
    content = F.map_filter(
        F.map_concat(F.from_json("props", "map<string,string>"), fixed), lambda _key, value: value.isNotNull()
    )
    return stats.attribute_census(events.select(content.alias("content")))


@registered("column_census", """
SELECT attribute, n FROM (
  SELECT 'doc_id' AS attribute, count(d.doc_id) AS n FROM documents d
  UNION ALL SELECT 'text', count(text) FROM documents
  UNION ALL SELECT 'quality', count(l.quality) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'toxic', count(l.toxic) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
""")
def column_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return stats.column_census(docs.join(table(spark, sf_dir, "labels"), "doc_id", "left"))


@registered("stage_counts", f"""
WITH {PAPERS_SQL}, marked AS (
  SELECT CASE WHEN title NOT LIKE '% %' THEN 'Null' || title ELSE title END AS title, lang FROM papers)
SELECT count(*) AS n_total, count(*) FILTER (WHERE NOT regexp_full_match(title, 'Null[^\\s]+')) AS n_kept,
       count(*) FILTER (WHERE lang = 'en') AS n_english
FROM marked
""".replace("\\\\", "\\"))
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(~F.col("title").like("% %"), F.concat(F.lit("Null"), F.col("title"))).otherwise(F.col("title"))
    rows = papers(spark, sf_dir).withColumn("title", title)
    return stats.stage_counts(
        rows, {"n_kept": ~is_placeholder_title(F.col("title")), "n_english": F.col("lang") == "en"}
    )


@registered("venue_year_stats", f"""
WITH {PAPERS_SQL}
SELECT venue, year, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de,
       count(*) FILTER (WHERE lang = 'fr') AS fr,
       count(*) FILTER (WHERE lang IS NULL OR lang NOT IN ('en', 'de', 'fr')) AS other
FROM papers GROUP BY venue, year
""")
def venue_year_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.venue_year_stats(papers(spark, sf_dir), ["en", "de", "fr"], "lang")


@registered("venue_year_totals", f"""
WITH {PAPERS_SQL}
SELECT venue, year, lang, CAST(grouping(venue, year, lang) AS INT) AS level, count(*) AS n
FROM papers GROUP BY ROLLUP (venue, year, lang)
""")
def venue_year_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.venue_year_totals(papers(spark, sf_dir), ["venue", "year", "lang"])


@registered("kept_counts", f"""
WITH {PAPERS_SQL}, landed AS (
  SELECT venue, year, lang, 1 AS harvest FROM papers
  UNION ALL SELECT venue, year, lang, 2 FROM papers WHERE lang IN ('de', 'fr') AND year <> 2023),
newest AS (SELECT * FROM landed QUALIFY harvest = max(harvest) OVER (PARTITION BY venue, year))
SELECT venue, year, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de,
       count(*) FILTER (WHERE lang NOT IN ('en', 'de')) AS other
FROM newest GROUP BY venue, year
""")
def kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two harvests of the papers come in as a stream; the second one replaces what it holds again."""
    source, path, state = (scratch_path(spark, name) for name in ("harvests", "counts", "counts-state"))
    rows = papers(spark, sf_dir).select("venue", "year", F.col("lang").alias("decision"))
    for number, harvest in enumerate((rows, rows.where("decision IN ('de', 'fr') AND year <> 2023")), 1):
        stamped = harvest.withColumn("snapshot_ts", F.to_timestamp(F.lit(f"2026-01-0{number} 00:00:00")))
        stamped.write.mode("append").parquet(source)
        counts.keep_counts(spark, source, stamped.schema, path, state).awaitTermination()
    return counts.current_stats(spark, path, ["en", "de"])


@registered("decision_stats", f"""
WITH {PAPERS_SQL}, named AS (
  SELECT venue, year, CASE lang WHEN 'fr' THEN replace(venue_text, 'Poster', 'Oral') WHEN 'de' THEN replace(venue_text, 'Poster', 'Spotlight')
                      ELSE venue_text END AS t FROM papers)
SELECT venue, year, CAST(0 AS BIGINT) AS withdrawn, CAST(0 AS BIGINT) AS rejected,
       count(*) FILTER (WHERE contains(t, 'Submitted')) AS submitted, count(*) FILTER (WHERE contains(t, ' Oral')) AS oral,
       count(*) FILTER (WHERE contains(t, ' Spotlight')) AS spotlight, count(*) FILTER (WHERE contains(t, ' Poster')) AS poster,
       CAST(0 AS BIGINT) AS other
FROM named GROUP BY venue, year
""")
def decision_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes read from the venue texts, then counted."""
    named = F.when(F.col("lang") == "fr", F.replace("venue_text", F.lit("Poster"), F.lit("Oral")))
    named = named.when(F.col("lang") == "de", F.replace("venue_text", F.lit("Poster"), F.lit("Spotlight"))).otherwise(F.col("venue_text"))
    rows = papers(spark, sf_dir).withColumn("decision", decision_class(named))
    return stats.venue_year_stats(rows, [name for name, _ in DECISIONS])
