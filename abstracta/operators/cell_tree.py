"""Two levels of centroids: a vector finds its cell in about the root of their number of steps.

``centroids`` has ``cell, grp, centroid``, ``groups`` has ``grp, center``. A vector is compared
with the centers, and then with the centroids of its ``breadth`` nearest groups only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from abstracta.operators.embed import evaluated_once
from abstracta.operators.knn import BROADCAST_BYTES, distances, knn_join, to_matrix
from abstracta.session import scratch_path

#: Vectors that teach, for each cell. They are drawn by a hash of the id, alike at every size.
SAMPLE_PER_CELL = 64
BREADTH = 3
_ROUNDS = 10
CENTROIDS = "cell bigint, grp bigint, centroid array<double>"
GROUPS = "grp bigint, center array<double>"


@dataclass(frozen=True)
class CellTree:
    centroids: DataFrame
    groups: DataFrame
    space: str = "cosine"


def tree_of(centroids: DataFrame, grp: str, space: str = "cosine") -> CellTree:
    """A tree over given centroids ``cell, <grp>, centroid``; a center is its centroids' mean."""
    known = centroids.select(F.col("cell").cast("bigint").alias("cell"), F.col(grp).cast("bigint").alias("grp"), "centroid")
    values = known.select("grp", F.posexplode("centroid").alias("pos", "value")).groupBy("grp", "pos").agg(F.avg("value").alias("mean"))
    # One entry for each dimension is gathered.
    center = F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda e: e["mean"])
    return CellTree(known, values.groupBy("grp").agg(center.alias("center")), space)


def grow(
    vectors: DataFrame, cells: int, dim: int, *, item_id: str = "id", vector: str = "embedding", space: str = "cosine",
    sample: int = SAMPLE_PER_CELL, seed: int = 0,
) -> CellTree:
    """Train about ``cells`` centroids in groups of about their root.

    The groups come from distributed k-means; each group's share of the cells from k-means over
    its own sample, a task for each group. At most ``sample`` vectors a cell teach; what is
    stored later is assigned whole. No usable vector, no tree.
    """
    known = vectors.where(F.col(vector).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("id"), F.col(vector).alias("v"))
    wanted = min(1.0, sample * cells / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(wanted * (1 << 30)))
    scaled = _scaled(dim, space)
    path = scratch_path(drawn.sparkSession, "cell-sample")
    drawn.select("id", scaled("v").alias("v")).where("v is not null").write.parquet(path)
    taught = drawn.sparkSession.read.parquet(path)
    total = taught.count()
    k1 = max(1, min(int(round(cells**0.5)), total))
    if not total:
        empty = drawn.sparkSession.createDataFrame
        return CellTree(empty([], CENTROIDS), empty([], GROUPS), space)
    model = KMeans(k=k1, seed=seed, maxIter=_ROUNDS, featuresCol="f").fit(taught.select(array_to_vector("v").alias("f")))
    centers = [(i, [float(x) for x in center]) for i, center in enumerate(model.clusterCenters())]
    groups = drawn.sparkSession.createDataFrame(centers, GROUPS)
    near = _nearest(groups.withColumnsRenamed({"grp": "cell", "center": "centroid"}), dim, "l2sq")
    placed = taught.withColumn("grp", near("v")[0])
    sizes = placed.groupBy("grp").agg(F.count("*").alias("size"))
    # A group's own k-means sees a bounded number of rows; the first by hash, found by group limits.
    share = F.greatest(F.lit(1), F.round(F.lit(cells) * F.col("size") / F.lit(total)).cast("int"))
    order = Window.partitionBy("grp").orderBy(F.xxhash64("id"), "id")
    placed = placed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample * cells)
    placed = placed.join(F.broadcast(sizes.select("grp", share.alias("k"))), "grp")

    def split(table: pa.Table) -> pa.Table:
        rows, k, grp = to_matrix(table.column("v"), dim), table.column("k")[0].as_py(), table.column("grp")[0].as_py()
        found = k_means(rows[np.argsort(table.column("nth").to_numpy())], k)
        return pa.table(
            {"grp": pa.array([grp] * len(found), pa.int64()), "n": pa.array(range(len(found)), pa.int64()), "centroid": pa.array(found.tolist(), pa.list_(pa.float64()))}
        )

    made = placed.select("grp", "nth", "k", "v").groupBy("grp").applyInArrow(split, "grp bigint, n bigint, centroid array<double>")
    # Cell numbers rise by group; there are as many rows as cells.
    number = F.row_number().over(Window.orderBy("grp", "n")) - 1
    centroids = made.select(number.cast("bigint").alias("cell"), "grp", "centroid")
    path = scratch_path(drawn.sparkSession, "centroids")
    centroids.write.parquet(path)
    return CellTree(drawn.sparkSession.read.parquet(path), groups, space)


def k_means(rows: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from spread-out distinct starts; at most ``k`` centroids."""
    chosen = [0]
    gap = np.square(rows - rows[0]).sum(1)
    while len(chosen) < k and gap.max() > 1e-12:  # the farthest row next
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.square(rows - rows[chosen[-1]]).sum(1))
    centroids = rows[chosen].copy()
    for _ in range(_ROUNDS):
        own = distances(rows, centroids, "l2sq").argmin(1)
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def _scaled(dim: int, space: str):
    @F.arrow_udf("array<double>")
    def scale(column: pa.Array) -> pa.Array:
        rows = to_matrix(column, dim)
        if space == "cosine":
            lengths = np.sqrt(np.square(rows).sum(1))[:, None]
            rows = np.divide(rows, lengths, out=np.full_like(rows, np.nan), where=lengths > 0)
        known = np.isfinite(rows.sum(1))
        return pa.array([row if good else None for row, good in zip(rows.tolist(), known)], pa.list_(pa.float64()))

    return evaluated_once(scale)


def _ranked(block: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(block * 10.0**digits + 0.5)


def _nearest(cells: DataFrame, dim: int, space: str, n: int = 1, digits: int = 6):
    """Column function: the ``n`` nearest of few centroids (``cell, centroid``), ties by number."""
    found = cells.select("cell", "centroid").toArrow().sort_by("cell")
    numbers, matrix = found.column("cell").to_numpy(), to_matrix(found.column("centroid"), dim)
    shared = cells.sparkSession.sparkContext.broadcast((numbers, matrix))

    @F.arrow_udf("array<bigint>")
    def nearest(column: pa.Array) -> pa.Array:
        (numbers, matrix), present = shared.value, np.flatnonzero(column.is_valid())
        rows = to_matrix(column.drop_null(), dim)
        order = np.argsort(_ranked(distances(rows, matrix, space), digits), axis=1, kind="stable")[:, :n]
        found = dict(zip(present.tolist(), numbers[order].tolist()))
        return pa.array([found.get(i) for i in range(len(column))], pa.list_(pa.int64()))

    return evaluated_once(nearest)


def assigned(
    vectors: DataFrame, tree: CellTree, dim: int, n: int = 1, breadth: int = BREADTH, *, vector: str = "embedding",
    name: str = "cells", digits: int = 6, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add the ``n`` nearest cells of each vector among those of its ``breadth`` nearest groups.

    Nearest first, by distance to ``digits`` digits, then number. A centroid table of over
    ``broadcast_bytes`` does not travel: vectors and centroids meet by group in blocks. NULL
    vectors, and any where there is no tree, get NULL.
    """
    count, groups = tree.centroids.count(), tree.groups.count()
    if not count or not groups:
        return vectors.withColumn(name, F.lit(None).cast("array<bigint>"))
    near = _nearest(tree.groups.withColumnsRenamed({"grp": "cell", "center": "centroid"}), dim, tree.space, breadth, digits)
    grouped = vectors.withColumn("_groups", near(vector))
    if count * dim * 8 <= broadcast_bytes:
        within = _within(_members(tree, dim), dim, n, tree.space, digits)
        return grouped.withColumn(name, within(vector, "_groups")).drop("_groups")
    spark = vectors.sparkSession
    path = scratch_path(spark, "to-assign")
    grouped.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    asking = rows.where("_groups is not null").select("_row", vector, "_groups")
    listed = tree.centroids.select("cell", F.col("centroid").alias(vector), F.array("grp").alias("_groups"))
    found = knn_join(
        asking, listed, n, dim, tree.space, query_id="_row", query_vector=vector, item_id="cell", item_vector=vector, cells="_groups", digits=digits
    )
    best = found.groupBy(F.col("query_id").alias("_row")).agg(  # n entries a row
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda c: c["id"]).alias(name)
    )
    return rows.drop("_groups").join(best, "_row", "left").drop("_row")


def _members(tree: CellTree, dim: int):
    """Cells and centroids of each group; checked to fit a broadcast."""
    table = tree.centroids.select("grp", "cell", "centroid").toArrow().sort_by([("grp", "ascending"), ("cell", "ascending")])
    groups, cells, matrix = table.column("grp").to_numpy(), table.column("cell").to_numpy(), to_matrix(table.column("centroid"), dim)
    found, starts = np.unique(groups, return_index=True)
    ends = np.r_[starts[1:], len(groups)]
    held = {int(g): (cells[a:b], matrix[a:b]) for g, a, b in zip(found, starts, ends)}
    return tree.centroids.sparkSession.sparkContext.broadcast(held)


def _within(shared, dim: int, n: int, space: str, digits: int):
    @F.arrow_udf("array<bigint>")
    def within(column: pa.Array, groups: pa.Array) -> pa.Array:
        members, present = shared.value, np.asarray(column.is_valid())
        rows, known = to_matrix(column.drop_null(), dim), groups.drop_null()
        owner = np.repeat(np.arange(len(rows)), np.diff(known.offsets.to_numpy()))
        asked = known.flatten().to_numpy(zero_copy_only=False)
        parts: list[tuple[np.ndarray, ...]] = []
        for grp in np.unique(asked):
            if int(grp) not in members:
                continue
            cells, matrix = members[int(grp)]
            mine = owner[asked == grp]
            ranked = _ranked(distances(rows[mine], matrix, space), digits)
            best = np.argsort(ranked, axis=1, kind="stable")[:, :n]
            parts.append((np.repeat(mine, best.shape[1]), np.take_along_axis(ranked, best, 1).ravel(), cells[best].ravel()))
        row, ranked, cell = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((cell, ranked, row))
        row, cell = row[order], cell[order]
        starts = np.searchsorted(row, np.arange(len(rows)))
        kept = np.arange(len(row)) - starts[row] < n if len(row) else np.zeros(0, bool)
        counts = np.zeros(len(column), np.int32)
        counts[present] = np.bincount(row[kept], minlength=len(rows))
        offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell[kept], pa.int64()), mask=pa.array(~present))

    return evaluated_once(within)
