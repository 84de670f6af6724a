"""Vector-table life cycle, batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from abstracta.catalog.registry import registered
from abstracta.catalog.searching import COSINE_SQL, DIM, TEXT_PAIRS_SQL, ranked_sql, terms_sql
from abstracta.operators.ann import cell_centroids
from abstracta.operators.cell_tree import BREADTH, tree_of
from abstracta.plans import index
from abstracta.plans.search import search_cells, search_collection
from abstracta.session import scratch_path, spread, table
from abstracta.streaming.incremental import incremental_index

_MODEL = "hashed-terms"
_SIZES_SQL = f"""{terms_sql("t", "doc_id", "documents")},
sizes AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id, d.lang, CAST(count(t.bucket) AS INT) AS n_terms,
                 coalesce(sum(t.weight), 0.0) AS n_tokens
          FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id, d.lang)"""


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("document"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"),
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _sizes(stored: DataFrame) -> list:
    tokens = F.aggregate("terms", F.lit(0.0), lambda total, term: total + term["weight"])
    return ["id", F.size("terms").alias("n_terms"), tokens.alias("n_tokens")]


def _store(spark: SparkSession) -> str:
    root = scratch_path(spark, "vectors")
    index.create_store(spark, root)
    return root


@registered("index_append", f"WITH {_SIZES_SQL} SELECT id, n_terms, n_tokens, CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS load FROM sizes")
def append(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, docs = _store(spark), _documents(spark, sf_dir)
    index.index_append(_rows(docs.where("lang = 'en'")), root, _MODEL, batch="a")
    index.index_append(_rows(docs.where("lang <> 'en'")), root, _MODEL, batch="b")
    stored = index.open_collection(spark, root, _MODEL)
    return stored.select(*_sizes(stored), F.col("batch").alias("load"))


@registered("index_rebuild", f"WITH {_SIZES_SQL} SELECT id, n_terms, n_tokens FROM sizes")
def rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, docs = _store(spark), _documents(spark, sf_dir)
    index.index_append(_rows(docs.where("lang = 'en'")), root, _MODEL)
    index.index_rebuild(_rows(docs), root, _MODEL)
    index.index_rebuild(_rows(docs), root, _MODEL)
    stored = index.open_collection(spark, root, _MODEL)
    return stored.select(*_sizes(stored))


@registered("index_resume", f"""
WITH {_SIZES_SQL}
SELECT id, n_terms, n_tokens,
       CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = sizes.doc_id) THEN 'first' ELSE 'second' END AS load
FROM sizes
""")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, docs = _store(spark), _documents(spark, sf_dir)
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    index.index_append(_rows(labelled), root, _MODEL, batch="first")
    for load in ("second", "third"):  # the third load finds nothing new
        index.index_resume(_rows(docs), root, _MODEL, batch=load)
    stored = index.open_collection(spark, root, _MODEL)
    return stored.select(*_sizes(stored), F.col("batch").alias("load"))


def _two_models(spark: SparkSession, sf_dir: str) -> str:
    root = _store(spark)
    dense = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.lit(None).cast("string").alias("document"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), "embedding",
    )
    index.index_append(dense, root, "dense-64", embed=lambda rows: rows)
    index.index_append(_rows(_documents(spark, sf_dir)), root, _MODEL)
    return root


@registered("open_collection", """
SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INT) AS n_values, CAST(label AS VARCHAR) AS label FROM embeddings
""")
def opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = index.open_collection(spark, _two_models(spark, sf_dir), "dense-64")
    return stored.select("id", F.size("embedding").alias("n_values"), F.col("metadata")["label"].alias("label"))


@registered("search_collection", f"""
WITH {TEXT_PAIRS_SQL},
named AS (SELECT query_id, CAST(p.id AS VARCHAR) AS id, distance FROM pairs p JOIN documents d ON d.doc_id = p.id WHERE d.lang = 'en'),
{ranked_sql('hits', 'named', 10)} SELECT query_id, id, rank, distance FROM hits
""")
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _store(spark)
    index.index_append(_rows(_documents(spark, sf_dir)), root, _MODEL)
    queries = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    hits = search_collection(spark, root, _MODEL, queries, 10, where=F.col("metadata")["lang"] == "en")
    return hits.select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


_GROUPS, _BREADTH, _PROBES = 5, 2, 3
_NEAR = "row_number() OVER (PARTITION BY a.vec_id ORDER BY round({0}, 6), {1})"
_CELLS_SQL = f"""means AS (
  SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, {DIM + 1})) AS i FROM embeddings)
  GROUP BY label, i),
centroids AS (SELECT label AS cell, label % {_GROUPS} AS grp, list(m ORDER BY i) AS embedding FROM means GROUP BY label),
centers AS (SELECT grp, list(m ORDER BY i) AS embedding FROM (SELECT label % {_GROUPS} AS grp, i, avg(m) AS m FROM means GROUP BY ALL) GROUP BY grp),
groups AS (
  SELECT a.vec_id, a.embedding, b.grp, {_NEAR.format(COSINE_SQL, "b.grp")} AS r FROM embeddings a, centers b),
probes AS (
  SELECT a.vec_id, a.embedding, b.cell, {_NEAR.format(COSINE_SQL, "b.cell")} AS r
  FROM groups a JOIN centroids b ON a.grp = b.grp WHERE a.r <= {_BREADTH}),
cells AS (
  SELECT a.vec_id, a.embedding, b.cell, {_NEAR.format(COSINE_SQL, "b.cell")} AS r
  FROM groups a JOIN centroids b ON a.grp = b.grp WHERE a.r <= {BREADTH})"""


@registered("search_cells", f"""
WITH {_CELLS_SQL},
near AS (
  SELECT a.vec_id AS query_id, CAST(b.vec_id AS VARCHAR) AS id, round({COSINE_SQL}, 6) + 0.0 AS distance
  FROM probes a JOIN cells b ON a.cell = b.cell WHERE a.r <= {_PROBES} AND b.r = 1 AND a.vec_id % 3 = 0),
{ranked_sql('hits', 'near', 10)} SELECT query_id, id, rank, distance FROM hits
""")
def inverted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into the cells of given centroids, then a search that reads the probed folders."""
    root, vectors = _store(spark), table(spark, sf_dir, "embeddings")
    centroids = cell_centroids(vectors, "label").withColumn("grp", F.col("cell") % _GROUPS)
    index.store_cells(root, "cells-64", tree_of(centroids, "grp"))
    for load in (0, 1):
        rows = vectors.where(F.col("vec_id") % 2 == load).select(
            F.col("vec_id").cast("string").alias("id"), F.lit(None).cast("string").alias("document"),
            F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), "embedding",
        )
        index.index_append(rows, root, "cells-64", lambda rows: rows, f"load{load}")
    queries = vectors.where(F.col("vec_id") % 3 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    hits = search_cells(spark, root, "cells-64", queries, 10, _PROBES, breadth=_BREADTH)
    return hits.select("query_id", "id", "rank", (F.round("distance", 6) + 0.0).alias("distance"))


@registered("list_collections", f"""
SELECT 'dense-64' AS model, count(*) AS n FROM embeddings UNION ALL SELECT '{_MODEL}', count(*) FROM documents
""")
def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.list_collections(spark, _two_models(spark, sf_dir))


@registered("incremental_index", f"""
WITH {_SIZES_SQL} SELECT id, n_terms, n_tokens, CASE WHEN lang IN ('de', 'fr') THEN 'first' ELSE 'second' END AS load FROM sizes
""")
def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, root, state = (scratch_path(spark, name) for name in ("harvest", "vectors", "state"))
    docs = _documents(spark, sf_dir)
    loads = []
    for harvest in (docs.where("lang IN ('de', 'fr')"), docs):  # the second harvest repeats the first
        _rows(harvest).write.mode("append").parquet(source)
        incremental_index(spark, source, root, _MODEL, state).awaitTermination()
        seen = {row["batch"] for row in index.read_store(spark, root).select("batch").distinct().collect()}
        loads.append(seen)
    stored = index.open_collection(spark, root, _MODEL)
    load = F.when(F.col("batch").isin(*loads[0]), "first").otherwise("second")
    return stored.select(*_sizes(stored), load.alias("load"))
