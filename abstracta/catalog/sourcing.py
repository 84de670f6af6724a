"""Snapshots, export blocks and page extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from abstracta.catalog.cleaning import _UNESCAPE
from abstracta.catalog.registry import PAPERS_SQL, SQL_SPACES, papers, registered
from abstracta.functions.html import unescape_html
from abstracta.functions.markup import Field, Selector, page_fields
from abstracta.plans.exports import export_results
from abstracta.session import scratch_path, spread, table
from abstracta.sources.pages import bibtex_link, explode_links, list_links as listed
from abstracta.sources.snapshot import read_snapshot, write_json_array, write_snapshot
from abstracta.sources.textfiles import RULE, read_export_blocks, write_export


@registered("read_snapshot", f"WITH {PAPERS_SQL} SELECT id, title, abstract, venue, year, lang FROM papers")
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir).select("id", "title", "abstract", "venue", "year", "lang")
    path = scratch_path(spark, "snapshot-json")
    write_json_array(rows, path)
    return read_snapshot(spark, path, rows.schema)


@registered("write_snapshot", f"""
WITH {PAPERS_SQL}
SELECT id, title, abstract, venue, year, '2026-01-02_03-04-05' AS stamp FROM papers
""")
def partitioned_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir).select("id", "title", "abstract", "venue", "year")
    stamped = rows.withColumn("snapshot_ts", F.to_timestamp(F.lit("2026-01-02 03:04:05")))
    path = scratch_path(spark, "snapshot")
    write_snapshot(stamped, path)
    stored = spark.read.schema(T.StructType(stamped.schema.fields)).parquet(path)
    return stored.select(*rows.columns, F.date_format("snapshot_ts", "yyyy-MM-dd_HH-mm-ss").alias("stamp"))


BLOCK_SQL = """'Title: ' || title || chr(10) || 'Venue: ' || venue || chr(10) || 'Link: ' || link || chr(10)
  || 'Affinity Score: ' || printf('%.4f', affinity) || chr(10) || 'BibTeX:' || chr(10) || bibtex"""


def exported(spark: SparkSession, sf_dir: str) -> str:
    """Write all papers as one ranked export; returns its path."""
    records = export_results(papers(spark, sf_dir, heavy=True).withColumn("score", F.col("affinity")))
    path = scratch_path(spark, "export")
    write_export(records, path, order=["doc_id"])
    return path


@registered("read_export_blocks", f"""
WITH {PAPERS_SQL}, whole AS (
  SELECT list_filter(string_split_regex(string_agg({BLOCK_SQL} || chr(10) || '{RULE}' || chr(10), '' ORDER BY doc_id), '-{{5,}}'),
                     lambda x: x <> '') AS pieces FROM papers)
SELECT pos, pieces[pos + 1] AS value FROM (SELECT pieces, unnest(range(len(pieces))) AS pos FROM whole)
""")
def export_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_export_blocks(spark, exported(spark, sf_dir)).select("pos", "value")


# ---- pages ------------------------------------------------------------------------------

_LINK = "<a href=\"([^\"]*)\">(.*?)</a>"
_TEXT = "array_to_string(list_filter(list_transform(string_split_regex({0}, '<[a-zA-Z/!][^>]*>'), lambda x: trim(x, " + SQL_SPACES + ")), lambda x: x <> ''), {1})"


def _links_sql(links: str, source: str = "pages") -> str:
    """Usable links of each page, numbered, with unescaped href and title."""
    return f"""listed AS (SELECT page_id, url, {links} AS links FROM {source}),
    numbered AS (SELECT page_id, url, CAST(i - 1 AS INT) AS pos, links[i] AS a FROM (
      SELECT *, unnest(range(1, len(links) + 1)) AS i FROM listed)),
    found AS (SELECT page_id, url, pos, {_UNESCAPE.format(_TEXT.format("regexp_extract(a, '>(.*)</a>', 1)", "''"))} AS title,
      {_UNESCAPE.format("regexp_extract(a, 'href=" + chr(34) + "([^" + chr(34) + "]*)', 1)")} AS href FROM numbered)"""


_ANCHORS = "list_filter(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>'), lambda a: NOT regexp_matches(a, '(href=\"\"|>\\s*</a>)'))"
_ROOT = "regexp_extract(url, '^[a-z]+://[^/?#]*')"


@registered("html_extract_list_links", f"WITH {_links_sql(_ANCHORS)} SELECT page_id, pos, title, {_ROOT} || href AS detail_url FROM found")
def list_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"))
    links = listed(F.col("html"), Selector(("li",)), None)
    return explode_links(pages, links, F.col("url"), "page_id", escaped=False)


@registered("html_links_fallback", f"""
WITH {_links_sql(f'''CASE WHEN regexp_matches(html, '(?s)<html lang="(de|fr)">.*</html>') AND len({_ANCHORS}) > 0 THEN {_ANCHORS}
     ELSE list_filter({_ANCHORS}, lambda a: contains(regexp_extract(a, 'href="([^"]*)', 1), 'e')) END''')}
SELECT page_id, pos, title, {_ROOT} || href AS detail_url FROM found
""")
def list_links_or_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"))
    links = listed(F.col("html"), Selector(("html",), "lang", ("de", "fr")), "e")
    return explode_links(pages, links, F.col("url"), "page_id", escaped=False)


@registered("resolve_url", f"""
WITH {_links_sql(_ANCHORS)}
SELECT page_id, pos, {_ROOT} || href AS absolute,
       regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '^(.*/)', 1) || ltrim(href, '/') AS relative,
       regexp_extract(url, '^([^:]*):', 1) || ':/' || href AS other_host
FROM found
""")
def resolve_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from abstracta.functions.records import resolve_url
    from abstracta.functions.html import anchors

    pages = spread(table(spark, sf_dir, "pages"))
    usable = F.filter(anchors(F.col("html")), lambda a: (a["href"] != "") & (a["text"] != ""))
    links = pages.select("page_id", "url", F.posexplode(usable).alias("pos", "a"))
    href = links.select("page_id", "url", "pos", unescape_html("a.href").alias("href"))
    url = F.col("url")
    return href.select(
        "page_id", "pos",
        resolve_url(url, F.col("href")).alias("absolute"),
        resolve_url(url, F.ltrim(F.col("href"), F.lit("/"))).alias("relative"),
        resolve_url(url, F.concat(F.lit("/"), F.col("href"))).alias("other_host"),
    )


@registered("html_extract_details", f"""
WITH shown AS (SELECT page_id, regexp_replace(html, '<!--.*?-->|<style>.*?</style>|<script>.*?</script>', '', 'gs') AS html FROM pages)
SELECT page_id,
       {_UNESCAPE.format(_TEXT.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)", "' '"))} AS title,
       {_UNESCAPE.format(_TEXT.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)", "' '"))} AS heading,
       {_UNESCAPE.format(_TEXT.format("regexp_extract(html, '(?s)<p>(.*?)</p>', 1)", "' '"))} AS abstract,
       {_UNESCAPE.format(_TEXT.format("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)", "' '"))} AS footer
FROM shown
""")
def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"title": "title", "heading": "h1", "abstract": "p", "footer": "footer"}
    fields = page_fields(F.col("html"), [Field(name, (Selector((tag,)),)) for name, tag in texts.items()])
    found = spread(table(spark, sf_dir, "pages")).select("page_id", fields.alias("p"))
    return found.select("page_id", *[F.coalesce(f"p.{name}", F.lit("")).alias(name) for name in texts])


@registered("bibtex_link_detect", f"""
WITH {_links_sql("list_filter(" + _ANCHORS + ", lambda a: contains(lower(a[9:]), 'en'))")}
SELECT p.page_id, {_ROOT.replace("url", "p.url")} || f.href AS bibtex_url
FROM pages p LEFT JOIN found f ON p.page_id = f.page_id AND f.pos = 0
""")
def bibtex_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"))
    return pages.select("page_id", bibtex_link(F.col("html"), F.col("url"), "en").alias("bibtex_url"))
