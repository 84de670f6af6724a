"""Searches from query text or vector to display records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from abstracta.functions.text import parse_keywords, strip_text
from abstracta.functions.vectors import score_search
from abstracta.operators.clean import fill_defaults, require_query_text
from abstracta.operators.embed import TERM_BUCKETS, embed_text, embedding_function, get_model
from abstracta.operators.knn import distance_to, knn_join
from abstracta.operators.ranking import topk_search
from abstracta.operators.cell_tree import assigned
from abstracta.plans.index import (
    open_collection, read_store, store_probes, stored_cells, stored_probes, tree_dim, without_superseded,
)
from abstracta.schema import DISPLAY_DEFAULTS
from abstracta.session import checkpointed

BROADCAST_ROWS = 500_000


def vector_search(
    vectors: DataFrame, query: Sequence[float], k: int = 50, space: str = "cosine", where: Column | None = None,
    item_id: str = "id", vector: str = "embedding", digits: int = 6,
) -> DataFrame:
    """``k`` nearest rows to one vector, among the rows that pass ``where``."""
    chosen = vectors if where is None else vectors.where(where)
    chosen = chosen.where(F.col(vector).isNotNull())
    return topk_search(chosen, k, F.round(distance_to(F.col(vector), query, space), digits), item_id)


def text_topk_search(
    queries: DataFrame, docs: DataFrame, k: int = 50, *, query_id: str = "query_id", item_id: str = "id",
    text: str = "text", dim: int = TERM_BUCKETS, **blocks: int,
) -> DataFrame:
    """``k`` nearest texts of each query text by cosine of hashed term counts.

    Texts are embedded inside the scan that scores them; the corpus is not shuffled.
    """
    asked = require_query_text(queries, text).where("error is null")
    return knn_join(
        asked, docs, k, dim, query_id=query_id, query_vector=text, item_id=item_id, item_vector=text, **blocks
    )


def search_collection(
    spark: SparkSession, root: str, model: str, queries: DataFrame, k: int = 50, *, where: Column | None = None,
    dense: bool = False, api_key: str = "", query_id: str = "query_id", text: str = "text", dim: int = TERM_BUCKETS,
    nprobe: int | None = None,
) -> DataFrame:
    """``k`` nearest stored vectors of each query text: ``query_id, id, distance, rank``.

    The queries are embedded with the model of the collection and meet its stored vectors;
    documents are not read. ``dense`` collections were loaded with the registered ``model``,
    the others with hashed terms. ``where`` is a condition on ``id`` and ``metadata``. With
    ``nprobe`` a dense collection that has cells is searched in so many of them.
    """
    if dense and nprobe is not None:
        asked = require_query_text(queries, text).where("error is null")
        asked = asked.withColumn("embedding", embedding_function(get_model(model, api_key))(text))
        return search_cells(spark, root, model, asked, k, nprobe, where=where, query_id=query_id)
    stored = open_collection(spark, root, model)
    stored = stored if where is None else stored.where(where)
    asked = require_query_text(queries, text).where("error is null")
    if dense:
        found = get_model(model, api_key)
        asked = asked.withColumn("embedding", embedding_function(found)(text))
        return knn_join(asked, stored, k, found.dim, query_id=query_id)
    asked = embed_text(asked, text, dim)
    return knn_join(asked, stored, k, dim, query_id=query_id, query_vector="terms", item_vector="terms")


def search_cells(
    spark: SparkSession, root: str, model: str, queries: DataFrame, k: int = 50, nprobe: int | None = None, *,
    where: Column | None = None, query_id: str = "query_id", vector: str = "embedding", breadth: int | None = None,
    digits: int = 6, **blocks: int,
) -> DataFrame:
    """``k`` nearest stored vectors of each query vector within the ``nprobe`` cells nearest to it.

    ``nprobe`` is by default the number that ``tune_cells`` has measured, or else all cells;
    ``breadth`` the groups whose cells are compared with a query, by default all.
    Only the folders of probed cells are read. The probed cells that the driver lists are at
    most as many as the folders, which it lists anyway. A cell is searched whole.
    """
    tree = stored_cells(spark, root, model)
    if tree is None:
        raise ValueError(f"No cells are stored for model: {model}")
    dim, most = tree_dim(tree), tree.centroids.count()
    nprobe = nprobe or stored_probes(spark, root, model) or most
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("embedding"))
    probing = checkpointed(assigned(asked, tree, dim, nprobe, breadth or most, digits=digits))
    probed = [row[0] for row in probing.select(F.explode("cells")).distinct().collect()]
    stored = without_superseded(read_store(spark, root).where((F.col("model") == model) & F.col("cell").isin(probed)), root)
    stored = stored if where is None else stored.where(where)
    held = stored.select("id", "embedding", F.array("cell").alias("cells"))
    return knn_join(probing, held, k, dim, tree.space, cells="cells", digits=digits, **blocks)


def tune_cells(
    spark: SparkSession, root: str, model: str, recall: float = 0.9, k: int = 10, queries: int = 200
) -> int:
    """Measure how many cells must be probed to find ``recall`` of the ``k`` nearest, and keep it.

    Stored vectors (at most about ``queries``, drawn by a hash of their id) ask for their exact
    neighbours in the whole collection. A neighbour is found as soon as its cell is probed, so
    its cell's place in the order of the query's cells tells the recall of every number.
    """
    tree = stored_cells(spark, root, model)
    if tree is None:
        raise ValueError(f"No cells are stored for model: {model}")
    dim, most = tree_dim(tree), tree.centroids.count()
    stored = without_superseded(read_store(spark, root).where((F.col("model") == model) & (F.col("cell") >= 0)), root)
    stored = stored.select("id", "embedding", "cell")
    share = min(1.0, queries / max(1, stored.count()))
    asked = stored.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    asked = checkpointed(assigned(asked.select(F.col("id").alias("query_id"), "embedding"), tree, dim, most, most))
    near = knn_join(asked.select("query_id", "embedding"), stored, k, dim, tree.space).select("query_id", "id")
    places = asked.select("query_id", F.posexplode("cells").alias("place", "cell"))
    met = stored.select("id", "cell").join(F.broadcast(near), "id")  # at most queries times k rows
    found = met.join(places, ["query_id", "cell"]).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()
    wanted, probes = recall * sum(row["n"] for row in found), 1
    for row in found:  # a row for each place at most
        if wanted <= 0:
            break
        wanted, probes = wanted - row["n"], row["place"] + 1
    store_probes(spark, root, model, probes)
    return probes


def collection_papers(stored: DataFrame) -> DataFrame:
    """Stored rows as papers: the metadata map's fields beside id and abstract."""
    fields = [F.col("metadata")[name].alias(name) for name in ("title", "keywords", "pdf", "bibtex")]
    return stored.select("id", F.col("document").alias("abstract"), *fields)


def search_records(hits: DataFrame, papers: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Ranked hits as display records; metadata is read for the hits only.

    Hits are a few rows per query, but the number of queries is the caller's: they are
    written out and counted, and broadcast only up to ``broadcast_rows``. More hits join
    the papers on id.
    """
    kept = checkpointed(hits)
    side = F.broadcast(kept) if kept.count() <= broadcast_rows else kept
    named = {"pdf": "link"} if "link" in papers.columns else {}
    renamed = papers.withColumnsRenamed({new: old for old, new in named.items()})
    joined = fill_defaults(renamed.join(side, "id"), DISPLAY_DEFAULTS)
    keywords = F.col("keywords")
    if dict(joined.dtypes)["keywords"] == "string":
        keywords = parse_keywords(keywords)
    return joined.select(
        "query_id", "rank", "id", "title",
        keywords.alias("keywords"),
        "pdf",
        strip_text(F.coalesce("abstract", F.lit(""))).alias("abstract"),
        "bibtex", "distance",
        score_search(F.col("distance")).alias("score"),
    )
