"""Registration, and the ``papers`` view over ``documents`` in both dialects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from abstracta.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(key: str, sql: str | None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = sql
        return query

    return add


# One text for both engines: documents seen as papers.
_PAPERS = """
doc_id,
CAST(doc_id AS STRING) AS id,
split_part(text, chr(10), 1) AS title,
text AS abstract,
source AS venue,
2021 + CAST(doc_id % 5 AS INT) AS year,
lang,
n_chars,
CASE WHEN n_chars < 800 THEN 'Submitted to ' || source ELSE source || ' Poster' END AS venue_text,
'https://papers.example.org/' || source || '/' || CAST(doc_id AS STRING) || '.pdf' AS link,
'@inproceedings{p' || CAST(doc_id AS STRING) || ',' || chr(10) || '  title = {' || split_part(text, chr(10), 1)
  || '},' || chr(10) || '  year = {' || CAST(2021 + doc_id % 5 AS STRING) || '}' || chr(10) || '}' AS bibtex,
CAST(n_chars % 1000 AS DOUBLE) / 1000 AS affinity
"""
PAPERS_SQL = f"papers AS (SELECT {_PAPERS} FROM documents)"


def papers(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """``heavy`` spreads the scan over all cores for costly per-row work."""
    docs = table(spark, sf_dir, "documents")
    columns = [line.strip() for line in _PAPERS.strip().replace("\n  ||", " ||").split(",\n")]
    return (spread(docs) if heavy else docs).selectExpr(*columns)


# Python's white space, as DuckDB text.
SQL_SPACES = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"
    "||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)"
    "||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
)


def rounded(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)
