"""Distances, scores, exact and approximate search, embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from abstracta.catalog.registry import PAPERS_SQL, papers, registered, rounded
from abstracta.functions.vectors import distance_cosine, distance_l2sq, score_affinity, score_search
from abstracta.operators.ann import ann_recall, ann_search_ivf, ann_search_lsh, cell_centroids, hyperplanes
from abstracta.operators.embed import (
    TERM_BUCKETS, embed_text, embedding_function, explode_terms, get_model, hashed_dense_model, register_model,
)
from abstracta.operators.knn import knn_join
from abstracta.operators.postings import postings_search
from abstracta.plans.results import read_page, store_results
from abstracta.plans.search import search_records, text_topk_search, vector_search
from abstracta.session import scratch_path, spread, table

DIM = 64

# ---- DuckDB building blocks -------------------------------------------------------------

COSINE_SQL = """1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
  / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
     * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"""
L2SQ_SQL = """list_sum(list_transform(range(1, len(a.embedding) + 1),
  lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))"""
NEXT_SQL = "embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def ranked_sql(name: str, pairs: str, k: int) -> str:
    return f"""{name} AS (SELECT * FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS rank FROM {pairs}) WHERE rank <= {k})"""


ALL_PAIRS_SQL = f"""pairs AS (SELECT query_id, id, exact, round(exact, 6) + 0.0 AS distance FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, {COSINE_SQL} AS exact FROM embeddings a, embeddings b))"""
# The displayed score comes from the distance as it is, not from the one rounded for ranking.
SCORE_SQL = "CASE WHEN exact <= 1 THEN round(1 - exact, 4) ELSE round(exact, 4) END + 0.0"


def terms_sql(name: str, key: str, source: str, dim: int = TERM_BUCKETS) -> str:
    return f"""{name} AS (
      SELECT {key}, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS INT) AS bucket, CAST(count(*) AS DOUBLE) AS weight
      FROM (SELECT {key}, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {source})
      WHERE w <> '' GROUP BY ALL)"""


TEXT_PAIRS_SQL = f"""{terms_sql("q", "item_id", "benchmark")}, {terms_sql("c", "doc_id", "documents")},
  qn AS (SELECT item_id, sqrt(sum(weight * weight)) AS len FROM q GROUP BY item_id),
  cn AS (SELECT doc_id, sqrt(sum(weight * weight)) AS len FROM c GROUP BY doc_id),
  dots AS (SELECT item_id, doc_id, sum(q.weight * c.weight) AS dot FROM q JOIN c USING (bucket) GROUP BY item_id, doc_id),
  pairs AS (SELECT item_id AS query_id, doc_id AS id, round(1 - dot / (qn.len * cn.len), 6) + 0.0 AS distance
            FROM dots JOIN qn USING (item_id) JOIN cn USING (doc_id))"""


# ---- inputs -----------------------------------------------------------------------------


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector next to the one with the following id."""
    e = table(spark, sf_dir, "embeddings")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(following, "vec_id")


def _rounded_hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "id", "rank", (F.round("distance", 6) + 0.0).alias("distance"))


# ---- distances and scores ---------------------------------------------------------------


@registered("distance_cosine", f"SELECT a.vec_id, round({COSINE_SQL}, 6) + 0.0 AS distance FROM {NEXT_SQL}")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = distance_cosine(F.col("embedding"), F.col("other"))
    return _neighbours(spark, sf_dir).select("vec_id", F.round(distance, 6).alias("distance"))


@registered("distance_l2sq", f"SELECT a.vec_id, round({L2SQ_SQL}, 6) + 0.0 AS distance FROM {NEXT_SQL}")
def l2sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = distance_l2sq(F.col("embedding"), F.col("other"))
    return _neighbours(spark, sf_dir).select("vec_id", F.round(distance, 6).alias("distance"))


@registered("score_search", f"""
SELECT vec_id, CASE WHEN d <= 1 THEN round(1 - d, 4) ELSE round(d, 4) END + 0.0 AS score
FROM (SELECT a.vec_id, {COSINE_SQL} AS d FROM {NEXT_SQL})
""")
def search_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = distance_cosine(F.col("embedding"), F.col("other"))
    return _neighbours(spark, sf_dir).select("vec_id", score_search(distance).alias("score"))


@registered("score_affinity", f"SELECT a.vec_id, round((2 - ({L2SQ_SQL})) / 2, 4) + 0.0 AS score FROM {NEXT_SQL}")
def affinity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = distance_l2sq(F.col("embedding"), F.col("other"))
    return _neighbours(spark, sf_dir).select("vec_id", F.round(score_affinity(distance), 4).alias("score"))


# ---- exact search -----------------------------------------------------------------------


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").head()[0]


_ONE_QUERY_SQL = f"""
SELECT b.vec_id AS id, round({COSINE_SQL}, 6) + 0.0 AS distance
FROM embeddings b, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) a
{{where}} ORDER BY distance, id LIMIT 50
"""


@registered("topk_search", _ONE_QUERY_SQL.format(where=""))
def one_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vector_search(_corpus(spark, sf_dir), _first_vector(spark, sf_dir), 50)
    return hits.select("id", (F.col("distance") + 0.0).alias("distance"))


@registered("topk_search_filtered", _ONE_QUERY_SQL.format(where="WHERE b.label IN (1, 3, 7)"))
def one_query_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.col("label").isin(1, 3, 7)
    hits = vector_search(_corpus(spark, sf_dir), _first_vector(spark, sf_dir), 50, where=chosen)
    return hits.select("id", (F.col("distance") + 0.0).alias("distance"))


@registered("knn_join", f"WITH {ALL_PAIRS_SQL}, {ranked_sql('hits', 'pairs', 10)} SELECT query_id, id, rank, distance FROM hits")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_hits(knn_join(_queries(spark, sf_dir), _corpus(spark, sf_dir), 10, DIM))


@registered("topk_per_query", f"""
WITH pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({L2SQ_SQL}, 6) + 0.0 AS distance
               FROM embeddings a, embeddings b), {ranked_sql('hits', 'pairs', 20)}
SELECT query_id, id, rank, distance FROM hits
""")
def nearest_l2sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_hits(knn_join(_queries(spark, sf_dir), _corpus(spark, sf_dir), 20, DIM, "l2sq"))


@registered("paginate", f"""
WITH {ALL_PAIRS_SQL}, {ranked_sql('hits', 'pairs', 25)}
SELECT query_id, id, rank, 3 AS page, 3 AS total_pages FROM hits WHERE rank > 20
""")
def last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = knn_join(_queries(spark, sf_dir), _corpus(spark, sf_dir), 25, DIM)
    path = scratch_path(spark, "results")
    store_results(hits.select("query_id", "id", "rank"), path, parts=8)
    return read_page(spark, path, 9).select("query_id", "id", "rank", "page", "total_pages")


@registered("embed_text", f"WITH {terms_sql('t', 'doc_id', 'documents')} SELECT doc_id, bucket, weight FROM t")
def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return explode_terms(embed_text(docs, "text"), "doc_id")


@registered("sparse_similarity_join", f"""
WITH {TEXT_PAIRS_SQL}, {ranked_sql('hits', 'pairs', 10)} SELECT query_id, id, rank, distance FROM hits
""")
def sparse_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = embed_text(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), "text")
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return _rounded_hits(postings_search(queries, embed_text(docs, "text"), 10))


@registered("text_topk_search", f"""
WITH {TEXT_PAIRS_SQL}, {ranked_sql('hits', 'pairs', 50)} SELECT query_id, id, rank, distance FROM hits
""")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return _rounded_hits(text_topk_search(queries, docs, 50))


@registered("embedding_function", f"""
WITH {terms_sql('t', 'doc_id', 'documents', DIM)},
n AS (SELECT doc_id, sqrt(sum(weight * weight)) AS len FROM t GROUP BY doc_id)
SELECT doc_id, bucket, round(CAST(CAST(weight / len AS FLOAT) AS DOUBLE), 6) + 0.0 AS weight FROM t JOIN n USING (doc_id)
""")
def dense_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_model(hashed_dense_model(DIM))
    embed_column = embedding_function(get_model(f"hashed-{DIM}"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    dense = docs.select("doc_id", embed_column("text").alias("embedding"))
    values = dense.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight <> 0")
    return values.select("doc_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight"))


@registered("search_records", f"""
WITH {PAPERS_SQL}, {ALL_PAIRS_SQL}, {ranked_sql('hits', 'pairs', 5)}
SELECT query_id, rank, h.id, CASE WHEN lang = 'de' THEN 'Untitled' ELSE title END AS title,
       CASE lang WHEN 'fr' THEN venue || '|' || lang ELSE venue END AS keywords,
       CASE WHEN n_chars < 1000 THEN '' ELSE link END AS pdf, trim(abstract, ' ' || chr(10)) AS abstract, bibtex,
       {SCORE_SQL} AS score
FROM hits h JOIN papers p ON p.doc_id = h.id
""")
def display_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir)
    listed = F.concat(F.lit("['"), F.col("venue"), F.lit("', '"), F.col("lang"), F.lit("']"))
    shown = rows.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("lang") != "de", F.col("title")).alias("title"),
        F.when(F.col("lang") == "fr", listed).otherwise(F.col("venue")).alias("keywords"),
        F.when(F.col("n_chars") >= 1000, F.col("link")).alias("link"),
        "abstract", "bibtex",
    )
    hits = knn_join(_queries(spark, sf_dir), _corpus(spark, sf_dir), 5, DIM)
    records = search_records(hits, shown).withColumn("keywords", F.array_join("keywords", "|"))
    return records.drop("distance")


# ---- approximate search -----------------------------------------------------------------

_PROBES = 3
_PLANES = hyperplanes(DIM, tables=4, bits=6, seed=7)

_IVF_SQL = f"""means AS (
  SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, {DIM + 1})) AS i FROM embeddings)
  GROUP BY label, i),
centroids AS (SELECT label, list(m ORDER BY i) AS embedding FROM means GROUP BY label),
probes AS (SELECT * FROM (
  SELECT a.vec_id AS query_id, a.embedding, b.label,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE_SQL}, 6), b.label) AS r
  FROM embeddings a, centroids b) WHERE r <= {_PROBES}),
near AS (SELECT a.query_id, b.vec_id AS id, round({COSINE_SQL}, 6) + 0.0 AS distance
         FROM probes a JOIN embeddings b ON a.label = b.label)"""


def _ivf(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    centroids = cell_centroids(corpus, "label")
    return ann_search_ivf(_queries(spark, sf_dir), corpus, centroids, k, DIM, _PROBES, cell="label")


@registered("ann_search_ivf", f"WITH {_IVF_SQL}, {ranked_sql('hits', 'near', 10)} SELECT query_id, id, rank, distance FROM hits")
def inverted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_hits(_ivf(spark, sf_dir))


def _lsh_sql() -> str:
    tables, bits, _dim = _PLANES.shape

    def signature(table_no: int) -> str:
        parts = []
        for bit in range(bits):
            normal = "[" + ", ".join(f"{x:.6f}" for x in _PLANES[table_no, bit]) + "]::DOUBLE[]"
            parts.append(f"CASE WHEN list_inner_product(embedding::DOUBLE[], {normal}) >= 0 THEN {1 << bit} ELSE 0 END")
        return f"SELECT vec_id, embedding, {table_no} AS t, {' + '.join(parts)} AS s FROM embeddings"

    signed = " UNION ALL ".join(signature(t) for t in range(tables))
    return f"""signed AS ({signed}),
    near AS (SELECT DISTINCT a.vec_id AS query_id, b.vec_id AS id, round({COSINE_SQL}, 6) + 0.0 AS distance
             FROM signed a JOIN signed b ON a.t = b.t AND a.s = b.s)"""


@registered("ann_search_lsh", f"WITH {_lsh_sql()}, {ranked_sql('hits', 'near', 10)} SELECT query_id, id, rank, distance FROM hits")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_hits(ann_search_lsh(_queries(spark, sf_dir), _corpus(spark, sf_dir), 10, DIM, _PLANES))


@registered("ann_recall", f"""
WITH {_IVF_SQL}, {ranked_sql('found', 'near', 10)}, {ALL_PAIRS_SQL}, {ranked_sql('exact', 'pairs', 10)}
SELECT e.query_id, round(avg(CASE WHEN f.id IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS recall
FROM exact e LEFT JOIN found f ON e.query_id = f.query_id AND e.id = f.id GROUP BY e.query_id
""")
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = knn_join(_queries(spark, sf_dir), _corpus(spark, sf_dir), 10, DIM)
    return ann_recall(exact, _ivf(spark, sf_dir)).select("query_id", rounded("recall"))
