"""Approximate nearest neighbours: search only the cells near a query, then rank exactly.

A cell column is an ``array<bigint>``: one coarse cell per vector (inverted file), or one
signature per hash table (locality-sensitive hashing). Cells are searched by the blocked
join of :mod:`abstracta.operators.knn`; a cell of any size is searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T

from abstracta.operators.embed import evaluated_once
from abstracta.operators.knn import BROADCAST_BYTES, Side, knn_join, to_matrix

LISTED_CELLS, PROBED_CELLS = 10_000, 1_000_000
#: Distances to centroids that a worker holds at a time.
ASSIGNED_PAIRS = 524_288


def cell_centroids(vectors: DataFrame, cell: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per cell: ``cell BIGINT, centroid ARRAY<DOUBLE>``."""
    values = vectors.select(F.col(cell).cast("bigint").alias("cell"), F.posexplode(vector).alias("pos", "value"))
    means = values.groupBy("cell", "pos").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    # At most dim entries per cell are gathered here.
    return means.groupBy("cell").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda e: e["mean"]).alias("centroid")
    )


def train_cells(vectors: DataFrame, cells: int, vector: str = "embedding", seed: int = 0) -> DataFrame:
    """Centroids from distributed k-means where no natural cell exists."""
    points = vectors.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(points)
    rows = [(i, [float(x) for x in center]) for i, center in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell bigint, centroid array<double>")


def _centroid_blocks(centroids: DataFrame, dim: int, block_bytes: int) -> Iterator[pa.Table]:
    """The centroids in pieces of about ``block_bytes``, each small enough to travel."""
    centroids = centroids.select("cell", "centroid")
    blocks = -(-centroids.count() * dim * 8 // block_bytes)
    for number in range(blocks):
        part = centroids if blocks == 1 else centroids.where(F.pmod(F.xxhash64("cell"), F.lit(blocks)) == number)
        rows = part.toArrow().sort_by("cell")
        if rows.num_rows:
            yield rows


def nearest_cells(
    vectors: DataFrame, centroids: DataFrame, dim: int, n: int, vector: str = "embedding", name: str = "cells",
    space: str = "cosine", digits: int = 6, block_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add the ``n`` nearest cells of each vector, nearest first, ties by cell number.

    Centroids of over ``block_bytes`` travel in blocks: each vector's nearest cells of every
    block, with their rounded distances, are ranked at the end. No centroids, no cells.
    """
    context, found = vectors.sparkSession.sparkContext, []
    for head in _centroid_blocks(centroids, dim, block_bytes):
        shared = context.broadcast((head.column("cell").to_numpy(), to_matrix(head.column("centroid"), dim)))
        found.append(evaluated_once(_nearest_in(shared, dim, n, space, digits))(vector))
    if not found:
        return vectors.withColumn(name, F.lit(None).cast("array<bigint>"))
    named = [f"_near{i}" for i in range(len(found))]
    near = vectors.withColumns(dict(zip(named, found)))
    best = F.slice(F.array_sort(F.concat(*named)), 1, n) if len(named) > 1 else F.col(named[0])
    return near.withColumn(name, F.transform(best, lambda c: c["cell"])).drop(*named)


def _nearest_in(shared: Broadcast, dim: int, n: int, space: str, digits: int):
    @F.arrow_udf("array<struct<distance: double, cell: bigint>>")
    def assign(column: pa.Array) -> pa.Array:
        cells, matrix = shared.value
        near, order = _ranked_cells(to_matrix(column, dim), matrix, n, space, digits)
        pairs = [pa.array(near.reshape(-1)), pa.array(cells[order].reshape(-1), pa.int64())]
        offsets = np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(pairs, ["distance", "cell"]))

    return assign


def _ranked_cells(
    rows: np.ndarray, matrix: np.ndarray, n: int, space: str, digits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Rounded distances and positions of each row's ``n`` nearest centroids.

    Rows are measured a slice at a time: a batch beside thousands of centroids has far more
    distances than a worker should hold.
    """
    centroids, width = Side(matrix, space), min(n, len(matrix))
    near, order = np.empty((len(rows), width)), np.empty((len(rows), width), np.int64)
    step = max(1, ASSIGNED_PAIRS // max(matrix.shape))
    for start in range(0, len(rows), step):
        part = slice(start, start + step)
        ranked = np.floor(Side(rows[part], space).to(centroids) * 10.0**digits + 0.5)
        order[part] = np.argsort(ranked, axis=1, kind="stable")[:, :width]
        near[part] = np.take_along_axis(ranked, order[part], 1)
    return near, order


def _lists(cells: np.ndarray) -> pa.Array:
    rows, width = cells.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.reshape(-1), pa.int64()))


def ann_search_ivf(
    queries: DataFrame, corpus: DataFrame, centroids: DataFrame, k: int, dim: int, nprobe: int,
    *, cell: str, query_id: str = "query_id", item_id: str = "id", space: str = "cosine", **blocks: int,
) -> DataFrame:
    """``k`` nearest rows within the ``nprobe`` cells nearest to each query."""
    probing = nearest_cells(queries.select(query_id, "embedding"), centroids, dim, nprobe, space=space)
    probed = probing.select(F.explode("cells").alias(cell)).distinct()
    # At most one number per centroid. A list makes a corpus partitioned by cell skip the
    # other folders; longer ones drop the rows in a join, which Spark chooses beyond a bound.
    most = centroids.count()
    if most <= LISTED_CELLS:
        corpus = corpus.where(F.col(cell).isin(*[row[0] for row in probed.collect()]))
    else:
        corpus = corpus.join(F.broadcast(probed) if most <= PROBED_CELLS else probed, cell, "left_semi")
    stored = corpus.select(item_id, "embedding", F.array(F.col(cell).cast("bigint")).alias("cells"))
    return knn_join(
        probing, stored, k, dim, space, query_id=query_id, item_id=item_id, cells="cells", **blocks
    )


def hyperplanes(dim: int, tables: int, bits: int, seed: int = 0) -> np.ndarray:
    """Normal vectors ``[tables, bits, dim]`` from a seeded rule, with six decimals."""
    return np.round(np.random.RandomState(seed).standard_normal((tables, bits, dim)), 6)


def lsh_cells(vectors: DataFrame, planes: np.ndarray, vector: str = "embedding", name: str = "cells") -> DataFrame:
    """Add one cell per hash table: the signs of the vector against the table's planes."""
    tables, bits, dim = planes.shape
    normals = planes.reshape(tables * bits, dim)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sign(column: pa.Array) -> pa.Array:
        above = (to_matrix(column, dim) @ normals.T >= 0).reshape(-1, tables, bits)
        signatures = (above * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
        return _lists(signatures + (np.arange(tables, dtype=np.int64) << bits))

    return vectors.withColumn(name, evaluated_once(sign)(vector))


def ann_search_lsh(
    queries: DataFrame, corpus: DataFrame, k: int, dim: int, planes: np.ndarray,
    *, query_id: str = "query_id", item_id: str = "id", space: str = "cosine", **blocks: int,
) -> DataFrame:
    """``k`` nearest rows among those that share a signature with the query in any table."""
    return knn_join(
        lsh_cells(queries.select(query_id, "embedding"), planes),
        lsh_cells(corpus.select(item_id, "embedding"), planes),
        k, dim, space, query_id=query_id, item_id=item_id, cells="cells", **blocks,
    )


def ann_recall(exact: DataFrame, approximate: DataFrame, keys: Sequence[str] = ("query_id", "id")) -> DataFrame:
    """Share of each query's exact results that the approximate search found."""
    found = approximate.select(*keys, F.lit(1.0).alias("hit"))
    joined = exact.join(found, list(keys), "left")
    return joined.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
