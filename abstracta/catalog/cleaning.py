"""Projections, filters, equi joins and list functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from abstracta.catalog.registry import PAPERS_SQL, SQL_SPACES, papers, registered
from abstracta.functions.markup import Field, Selector, page_fields
from abstracta.functions.records import normalize_pdf_url, rename_keys, unwrap_content
from abstracta.functions.text import file_stamp, format_keywords, parse_keywords, safe_filename, split_authors, strip_text
from abstracta.functions.records import coalesce_title
from abstracta.operators import clean
from abstracta.operators.joins import first_nonempty_source, list_detail_join, review_enrichment, union_venues
from abstracta.operators.ranking import assign_ids, dedup_first_seen, dense_position, limit_first_n
from abstracta.schema import RENAMES_API, RENAMES_CRAWL
from abstracta.session import spread, table


@registered("unwrap_value", """
SELECT event_id, json_extract_string(props, '$.k') AS k, event_type, CAST(value AS VARCHAR) AS plain
FROM (SELECT event_id, props, event_type, CAST(value * 100 AS BIGINT) AS value FROM events)
""")
def unwrap_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(table(spark, sf_dir, "events"))
    content = F.create_map(
        F.lit("k"), F.concat(F.lit('{"value": '), F.get_json_object("props", "$.k"), F.lit("}")),
        F.lit("event_type"), F.concat(F.lit('{"value": "'), F.col("event_type"), F.lit('"}')),
        F.lit("plain"), F.round(F.col("value") * 100).cast("bigint").cast("string"),
    )
    entry = F.col("entry")
    return events.select("event_id", unwrap_content(content).alias("entry")).select(
        "event_id", *[entry[k].alias(k) for k in ("k", "event_type", "plain")]
    )


# Page paths in the forms a pdf field takes: absolute, one or two slashes, no value.
_PDF = r"""CASE WHEN url LIKE 'http:%' THEN '/' || path WHEN url LIKE '%://m.%' THEN 'https://papers.example.org' || path
           WHEN url LIKE '%#top' THEN '' ELSE path END"""


@registered("normalize_pdf_url", rf"""
SELECT page_id, CASE WHEN v <> '' AND NOT starts_with(v, 'https://papers.example.org/')
                     THEN 'https://papers.example.org/' || ltrim(v, '/') ELSE v END AS pdf
FROM (SELECT page_id, {_PDF} AS v FROM (SELECT *, regexp_extract(url, '^https?://[^/]+(/.*)$', 1) AS path FROM pages))
""")
def normalize_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("path", F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1))
    return pages.select("page_id", normalize_pdf_url(F.expr(_PDF), "https://papers.example.org/").alias("pdf"))


@registered("rename_fields", f"""
WITH {PAPERS_SQL}
SELECT doc_id, title, link, bibtex AS _bibtex, link AS map_link, title AS map_title FROM papers
""")
def rename_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir).select("doc_id", "title", F.col("link").alias("detail_url"), "bibtex")
    content = rename_keys(F.create_map(F.lit("title"), F.col("title"), F.lit("pdf"), F.col("detail_url")), RENAMES_API)
    mapped = rows.withColumns({"map_link": content["link"], "map_title": content["title"]})
    return clean.rename_fields(mapped, RENAMES_CRAWL)


@registered("tag_source", "SELECT doc_id, text, 'ICLR' AS venue, 2026 AS year FROM documents")
def tag_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.tag_source(table(spark, sf_dir, "documents").select("doc_id", "text"), " iclr\t", 2026)


@registered("split_metadata", """
SELECT CASE WHEN n_chars < 300 THEN '' ELSE text END AS document, CAST(doc_id AS VARCHAR) AS doc_id, lang, source,
       CAST(3 AS INT) AS n_fields
FROM documents
""")
def split_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", "source", F.when(F.col("n_chars") >= 300, F.col("text")).alias("abstract"))
    split = clean.split_metadata(rows)
    fields = [F.col("metadata")[k].alias(k) for k in ("doc_id", "lang", "source")]
    return split.select("document", *fields, F.size("metadata").alias("n_fields"))


_HOLES = {"title": "lang = 'de'", "keywords": "lang = 'fr'", "pdf": "n_chars < 1000", "bibtex": "lang = 'es'"}


@registered("fill_defaults", f"""
WITH {PAPERS_SQL}
SELECT doc_id, CASE WHEN lang = 'de' THEN 'Untitled' ELSE title END AS title,
       CASE WHEN lang = 'fr' THEN '' ELSE venue END AS keywords,
       CASE WHEN n_chars < 1000 THEN '' ELSE link END AS pdf,
       CASE WHEN lang = 'es' THEN '' ELSE bibtex END AS bibtex
FROM papers
""")
def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir).withColumnsRenamed({"venue": "keywords", "link": "pdf"})
    holes = {name: F.when(~F.expr(rule), F.col(name)) for name, rule in _HOLES.items()}
    filled = clean.fill_defaults(rows.withColumns(holes), {"title": "Untitled", "keywords": "", "pdf": "", "bibtex": ""})
    return filled.select("doc_id", "title", "keywords", "pdf", "bibtex")


@registered("strip_text", f"""
SELECT doc_id, trim(chr(9) || chr(160) || text || chr(12288) || chr(10), {SQL_SPACES}) AS text FROM documents
""")
def strip_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("\t\xa0"), F.col("text"), F.lit("　\n"))
    return table(spark, sf_dir, "documents").select("doc_id", strip_text(padded).alias("text"))


# The references that occur in the pages; a page cut short may end in one without semicolon.
_UNESCAPE = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&middot;?', '·', 'g'), '&copy;?', '©', 'g'),"
    " '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"
)


@registered("coalesce_title", f"""
SELECT page_id, coalesce(nullif(CASE WHEN url LIKE '%#top' THEN '' WHEN url LIKE 'http:%' THEN NULL
                                     ELSE {_UNESCAPE.format("trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))")} END, ''),
                         url) AS title
FROM pages
""")
def coalesce_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    title = page_fields(F.col("html"), [Field("t", (Selector(("title",)),), joiner="")])
    titled = spread(pages).select("page_id", "url", title["t"].alias("t"))
    detail = F.when(F.col("url").like("%#top"), "").when(F.col("url").like("http:%"), None).otherwise(F.col("t"))
    return titled.select("page_id", coalesce_title(detail, F.col("url")).alias("title"))


@registered("safe_filename", f"""
WITH {PAPERS_SQL}
SELECT doc_id, printf('%02d', doc_id + 1) || ' - ' || printf('%.2f', affinity) || ' - ' ||
       regexp_replace(venue, '[^a-zA-Z0-9_\\- ]', '', 'g') || ' - ' ||
       regexp_replace(title, '[^a-zA-Z0-9_\\- ]', '', 'g') || '.pdf' AS file_name
FROM papers
""".replace("\\\\", "\\"))
def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = safe_filename(F.col("doc_id") + 1, F.col("affinity"), F.col("venue"), F.col("title"))
    return papers(spark, sf_dir, heavy=True).select("doc_id", name.alias("file_name"))


# Titles that look like withdrawn placeholders, or only start like one.
_PLACEHOLDERS = """CASE WHEN n_chars < 200 THEN NULL WHEN title NOT LIKE '% %' THEN 'Null' || title
                        WHEN lang = 'de' THEN 'Null ' || title ELSE title END"""


@registered("drop_placeholder_titles", f"""
WITH {PAPERS_SQL}
SELECT * FROM (SELECT doc_id, {_PLACEHOLDERS} AS title FROM papers)
WHERE title IS NULL OR NOT regexp_full_match(title, 'Null[^\\s]+')
""".replace("\\\\", "\\"))
def drop_placeholder_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir, heavy=True).select("doc_id", F.expr(_PLACEHOLDERS).alias("title"))
    return clean.drop_placeholder_titles(rows)


@registered("drop_short_titles", f"""
WITH {PAPERS_SQL}
SELECT doc_id FROM (SELECT doc_id, CASE WHEN n_chars >= 300 THEN title END AS title FROM papers)
WHERE length(coalesce(title, '')) >= 5
""")
def drop_short_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir).select("doc_id", F.when(F.col("n_chars") >= 300, F.col("title")).alias("title"))
    return clean.drop_short_titles(rows).select("doc_id")


@registered("accepted_only", f"WITH {PAPERS_SQL} SELECT doc_id, venue_text FROM papers WHERE NOT contains(venue_text, 'Submi')")
def accepted_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir).select("doc_id", "venue_text")
    return clean.accepted_only(rows, "venue_text", "ICLR", "Accepted")


@registered("venue_year_filter", f"""
WITH {PAPERS_SQL}
SELECT doc_id, venue, year FROM papers WHERE venue IN ('src1', 'src3', 'src7') AND year IN (2022, 2024)
""")
def venue_year_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.venue_year_filter(
        papers(spark, sf_dir).select("doc_id", "venue", "year"), ["src1", "src3", "src7"], [2022, 2024]
    )


@registered("language_filter", "SELECT doc_id, lang, text FROM documents WHERE lang IN ('fr', 'es')")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.language_filter(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["fr", "es"])


@registered("require_query_text", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN NULL ELSE 'Please enter a query.' END AS error FROM conversations
""")
def require_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit(" \t\n"))
    queries = table(spark, sf_dir, "conversations").withColumn("text", text)
    return clean.require_query_text(queries).select("conv_id", "turn", "error")


_NAMES = "list_filter(list_transform(string_split(abstract, ','), lambda x: trim(x, " + SQL_SPACES + ")), lambda x: x <> '')"


@registered("split_authors", f"""
WITH {PAPERS_SQL}
SELECT doc_id, array_to_string({_NAMES}, '|') AS authors, CAST(len({_NAMES}) AS INT) AS n FROM papers
""")
def split_author_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = papers(spark, sf_dir, heavy=True).select("doc_id", split_authors(F.col("abstract")).alias("a"))
    return listed.select("doc_id", F.array_join("a", "|").alias("authors"), F.size("a").alias("n"))


@registered("nonempty_authors", f"""
WITH {PAPERS_SQL}, listed AS (SELECT doc_id, ',, ' || replace(abstract, '.', ',') AS abstract FROM papers)
SELECT doc_id, array_to_string({_NAMES}, '|') AS authors, CAST(len({_NAMES}) AS INT) AS n FROM listed
""")
def nonempty_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.concat(F.lit(",, "), F.replace(F.col("abstract"), F.lit("."), F.lit(",")))
    listed = papers(spark, sf_dir, heavy=True).select("doc_id", split_authors(names).alias("a"))
    return listed.select("doc_id", F.array_join("a", "|").alias("authors"), F.size("a").alias("n"))


_WORDS = "regexp_extract_all(abstract, '[a-zA-Z]+')"


@registered("parse_keywords", f"""
WITH {PAPERS_SQL}, w AS (SELECT doc_id, lang, {_WORDS} AS words FROM papers),
kw AS (
  SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN words
                      WHEN lang = 'de' THEN [array_to_string(words, ', ')]
                      ELSE ['[''' || array_to_string(words, ''', ''')] END AS keywords FROM w)
SELECT doc_id, array_to_string(keywords, '|') AS keywords, CAST(len(keywords) AS INT) AS n FROM kw
""")
def parse_keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("abstract", F.lit("([a-zA-Z]+)"), F.lit(1))
    single, double = F.array_join(words, "', '"), F.array_join(words, '", "')
    raw = (
        F.when(F.size(words) == 0, F.when(F.col("lang").isin("en", "fr"), "[]").when(F.col("lang") == "de", "").otherwise("['"))
        .when(F.col("lang") == "en", F.concat(F.lit("['"), single, F.lit("']")))
        .when(F.col("lang") == "fr", F.concat(F.lit('["'), double, F.lit('"]')))
        .when(F.col("lang") == "de", F.array_join(words, ", "))
        .otherwise(F.concat(F.lit("['"), single))
    )
    parsed = papers(spark, sf_dir, heavy=True).select("doc_id", parse_keywords(raw).alias("k"))
    return parsed.select("doc_id", F.array_join("k", "|").alias("keywords"), F.size("k").alias("n"))


_CASED = "upper(w[1]) || lower(w[2:])"


@registered("format_keywords", f"""
WITH {PAPERS_SQL}
SELECT doc_id, array_to_string(list_transform(list_filter(string_split(replace(abstract, ',', ' ,'), ' '), lambda k: k <> ''),
         lambda k: array_to_string(list_transform(regexp_extract_all(trim(k, {SQL_SPACES}), '[a-zA-Zà-öø-ÿÀ-ÖØ-ß]+|[^a-zA-Zà-öø-ÿÀ-ÖØ-ß]+'),
           lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' || lower(w[2:]) ELSE {_CASED} END), '')), ' ') AS keywords
FROM papers
""")
def format_keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.replace(F.col("abstract"), F.lit(","), F.lit(" ,")), " ")
    return papers(spark, sf_dir, heavy=True).select("doc_id", F.array_join(format_keywords(words), " ").alias("keywords"))


@registered("build_file_stamp", """
SELECT o_orderkey, 'notes_' || o_orderpriority || CAST(year(o_orderdate) AS VARCHAR) || '_' || o_orderstatus || '_' ||
       strftime(o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)), '%Y-%m-%d_%H-%M-%S') AS stamp
FROM orders
""")
def build_file_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    ts = F.expr("CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(0, 0, 0, o_orderkey % 86400)")
    stamp = file_stamp(F.col("o_orderpriority"), F.year("o_orderdate"), F.col("o_orderstatus"), ts)
    return orders.select("o_orderkey", stamp.alias("stamp"))


@registered("list_detail_join", """
SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'good ' || d.source ELSE d.source END AS title, l.toxic,
       CAST(coalesce(len(CASE WHEN l.doc_id IS NOT NULL THEN [l.quality, l.toxic] END), 0) AS INT) AS n_authors
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def list_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"))
    labels = table(spark, sf_dir, "labels")
    details = labels.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select(
        "doc_id",
        F.when(F.col("quality") == 1, F.concat(F.lit("good "), F.col("source"))).otherwise("").alias("title"),
        F.array(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("authors"),
        "toxic",
    )
    joined = list_detail_join(entries, details, "doc_id")
    return joined.select("doc_id", "title", "toxic", F.size("authors").alias("n_authors"))


@registered("review_enrichment", """
SELECT d.doc_id, coalesce(r.n, 0) AS n_reviews, round(r.rating, 6) + 0.0 AS rating,
       round(r.confidence, 6) + 0.0 AS confidence, 'https://forum.example.org/?id=' || CAST(d.doc_id AS VARCHAR) AS forum
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, avg(quality) AS rating, avg(toxic) AS confidence
                            FROM labels GROUP BY doc_id) r ON d.doc_id = r.doc_id
""")
def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    enriched = review_enrichment(
        table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"),
        {"quality": "rating", "toxic": "confidence"}, "doc_id", "https://forum.example.org/?id=",
    )
    return enriched.withColumns({c: F.round(c, 6) for c in ("rating", "confidence")})


@registered("first_nonempty_source", f"""
WITH {PAPERS_SQL}, tagged AS (
  SELECT doc_id, venue, year, lang, CASE lang WHEN 'es' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS source_rank
  FROM papers)
SELECT doc_id, venue, year, lang, source_rank FROM (
  SELECT *, min(source_rank) OVER (PARTITION BY venue, year) AS best FROM tagged) WHERE source_rank = best
""")
def first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir).select("doc_id", "venue", "year", "lang")
    return first_nonempty_source([rows.where(F.col("lang") == lang) for lang in ("es", "de", "fr", "en")])


@registered("union_venues", f"""
WITH {PAPERS_SQL}
SELECT doc_id, venue, CASE WHEN lang <> 'de' THEN title END AS title, CASE WHEN lang = 'en' THEN link END AS link FROM papers
""")
def union_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir)
    return union_venues([
        rows.where("lang = 'en'").select("doc_id", "venue", "title", "link"),
        rows.where("lang IN ('fr', 'es')").select("doc_id", "title", "venue"),
        rows.where("lang = 'de'").select("venue", "doc_id"),
    ])


@registered("dedup_first_seen", """
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1
""")
def dedup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Long texts are compared by digest, so the exchange carries 64 characters per row.
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    return dedup_first_seen(docs, "digest", "doc_id").drop("digest")


@registered("assign_ids", """
SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS id FROM documents
""")
def positional_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Positions far apart, as after a filter.
    kept = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 1000).alias("place"))
    return assign_ids(kept, "place").drop("place")


@registered("rank_results", """
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents
""")
def rank_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return dense_position(docs, "doc_id", "rank", start=1, keys=["source"])


@registered("limit_first_n", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 1000")
def first_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_first_n(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 1000)
