"""Exact top-k search by integer inner product over KD-trees, one per shard.

A shard is up to ``SHARD_ROWS`` consecutive vectors of a scan task: nothing is shuffled to
build the trees. Each is split at the median of its widest side until a leaf holds at most
``LEAF_ROWS`` vectors, every node keeps its tight bounding box, and the trees are written to
the shared folder, a row per shard. Building a shard also answers, inside that shard, the
queries that lie in it; the kth score found there is where each query's bound starts.

Queries then go over all shards in blocks of bounded size. A query visits the nodes of a tree
best first, by the largest inner product that the box allows; a box that cannot beat the kth
score so far (or, at equal score, its id) ends the visit. The bound goes on from shard to shard
of a task. Each task keeps k rows per query; the merge ranks those.

Vectors are ``floor(scale * x)`` of the components as doubles. Defined results: null vectors,
vectors with a null or non-finite component and rows with a null id take no part; components
beyond the 64-bit range count as its ends and products wrap as longs do; a query sees only
vectors of its own length; a repeated id is searched once as a query (its smallest vector),
each of its rows is a candidate for the others; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from abstracta.llm.common import arrow_schema, stored

SHARD_ROWS, LEAF_ROWS = 8192, 256
BLOCK_BYTES = 32 << 20
EXACT = 2**53
TREE = "dim int, ids binary, vectors binary, lows binary, highs binary, least_ids binary, children binary, spans binary"
SHARD = TREE + ", asked array<long>, floors array<long>"
FOUND = "query_id long, vec_id long, score long"


def quantized(embedding: np.ndarray, scale: int) -> np.ndarray:
    low, high = -(2.0**63), 2.0**63 - 1024
    return np.clip(np.floor(embedding * scale), low, high).astype(np.int64)


class Tree:
    """KD-tree over the rows of ``vectors``; node 0 is the root."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        order = np.arange(len(ids))
        children, spans, lows, highs, least = [], [], [], [], []

        def build(start: int, end: int) -> int:
            rows = order[start:end]
            low, high = vectors[rows].min(0), vectors[rows].max(0)
            node = len(spans)
            spans.append((start, end)), children.append((-1, -1))
            lows.append(low), highs.append(high), least.append(ids[rows].min())
            if end - start > leaf_rows and (high > low).any():
                # Widths as doubles: they only choose a side, and longs could overflow.
                side = int(np.argmax(high.astype(float) - low.astype(float)))
                middle = (end - start) // 2
                order[start:end] = rows[np.argpartition(vectors[rows, side], middle, kind="introselect")]
                children[node] = build(start, start + middle), build(start + middle, end)
            return node

        build(0, len(ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.children, self.spans = np.array(children), np.array(spans)
        self.lows, self.highs, self.least = np.array(lows), np.array(highs), np.array(least)

    def packed(self) -> tuple:
        parts = (self.ids, self.vectors, self.lows, self.highs, self.least, self.children, self.spans)
        return self.vectors.shape[1], *(np.ascontiguousarray(p, dtype="<i8").tobytes() for p in parts)

    @classmethod
    def unpacked(cls, dim: int, *parts: bytes) -> Tree:
        tree = cls.__new__(cls)
        ids, vectors, lows, highs, least, children, spans = (np.frombuffer(p, "<i8") for p in parts)
        tree.ids, tree.least = ids, least
        tree.vectors, tree.lows, tree.highs = (a.reshape(-1, dim) for a in (vectors, lows, highs))
        tree.children, tree.spans = children.reshape(-1, 2), spans.reshape(-1, 2)
        return tree

    def search(self, query_ids: np.ndarray, queries: np.ndarray, best: list[list], k: int) -> list[list]:
        """Improve ``best``, per query a heap of its k best ``(score, -id, number)``; the new ones of each."""
        widest = max(_largest(self.lows), _largest(self.highs))
        exact = widest * _largest(queries) * self.vectors.shape[1] < EXACT
        kind = np.float64 if exact else np.int64  # doubles hold such sums exactly and are faster
        vectors, asked = self.vectors.astype(kind), queries.astype(kind)
        if exact:
            lows, highs = self.lows.astype(kind), self.highs.astype(kind)
            bounds = np.maximum(asked, 0) @ highs.T + np.minimum(asked, 0) @ lows.T
        else:
            bounds = np.full((len(asked), len(self.spans)), np.inf)  # products may wrap: no box is safe
        found, count = [], itertools.count()
        for number, (own, query) in enumerate(zip(query_ids.tolist(), asked)):
            heap, new, bound = best[number], set(), bounds[number]
            nodes = [(-bound[0], 0)]
            while nodes:
                least, node = heapq.heappop(nodes)
                if len(heap) == k and (-least, -int(self.least[node])) < heap[0]:
                    if -least < heap[0][0]:
                        break  # the best box left is below the kth score
                    continue
                left, right = self.children[node]
                if left >= 0:
                    heapq.heappush(nodes, (-bound[left], left))
                    heapq.heappush(nodes, (-bound[right], right))
                    continue
                start, end = self.spans[node]
                scores = vectors[start:end] @ query
                ids = self.ids[start:end]
                good = np.flatnonzero((ids != own) & (scores >= heap[0][0] if len(heap) == k else ids != own))
                if len(good) > k:
                    good = good[np.lexsort((ids[good], -scores[good]))[:k]]
                for score, vec in zip(scores[good].tolist(), ids[good].tolist()):
                    entry = (int(score), -vec, next(count))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    else:
                        continue
                    new.add(entry)
            found.append([entry[:2] for entry in new.intersection(heap)])
        return found


def _largest(values: np.ndarray) -> float:
    return float(np.abs(values.astype(np.float64)).max(initial=0))


def _grouped(batch: pa.RecordBatch, scale: int):
    """Per vector length the row numbers and quantised vectors of a batch of ``id, vector``."""
    lists = batch.column("vector")
    lengths = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten())
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield int(dim), rows, quantized(flat[starts[rows][:, None] + np.arange(dim)], scale)


def clean(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, vector`` of the rows that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & good & (F.size("vector") > 0))


def build(rows: DataFrame, k: int, scale: int, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The trees of ``id, vector, asked`` rows, a row per shard.

    ``asked, floors`` list the shard's queries that have k other rows in it, and their kth score.
    """
    schema = arrow_schema(SHARD)

    def task(batches):
        held: dict[int, list] = {}

        def shard(dim):
            every = [np.concatenate(part) for part in zip(*held.pop(dim))]
            for start in range(0, len(every[0]), shard_rows):
                ids, vectors, asked = (part[start : start + shard_rows] for part in every)
                tree = Tree(ids, vectors, leaf_rows)
                best = [[] for _ in range(asked.sum())]
                tree.search(ids[asked], vectors[asked], best, k)
                full = [(q, heap[0][0]) for q, heap in zip(ids[asked].tolist(), best) if len(heap) == k]
                row = (*tree.packed(), [q for q, _ in full], [floor for _, floor in full])
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            ids, asked = np.asarray(batch.column("id")), batch.column("asked").to_numpy(zero_copy_only=False)
            for dim, at, vectors in _grouped(batch, scale):
                held.setdefault(dim, []).append((ids[at], vectors, asked[at]))
                if sum(len(part[0]) for part in held[dim]) >= shard_rows:
                    yield from shard(dim)
        for dim in list(held):
            yield from shard(dim)

    return rows.mapInArrow(task, SHARD)


def search(shards: DataFrame, k: int, block) -> DataFrame:
    """Search every shard for the broadcast queries: per vector length ids, vectors and floors."""
    schema = arrow_schema(FOUND)

    def task(batches):
        state: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                dim, tree = row[0], Tree.unpacked(*row)
                if dim not in block.value:
                    continue
                ids, queries, floors = block.value[dim]
                if dim not in state:
                    # A floor stands for k unknown rows of that score with the largest id.
                    state[dim] = [[(f, -(2**63), -1)] * k if f is not None else [] for f in floors]
                found = tree.search(ids, queries, state[dim], k)
                out = [(q, -vec, score) for q, new in zip(ids.tolist(), found) for score, vec in new]
                columns = list(zip(*out)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return shards.select([part.split()[0] for part in TREE.split(", ")]).mapInArrow(task, FOUND)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    scale: int = 256,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of every row for which ``is_query`` holds.

    ``is_query`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    rows = clean(vectors, id_column, vector_column)
    shards = stored(build(rows.withColumn("asked", is_query), k, scale, shard_rows), "kd-trees")
    floors = shards.select(F.inline(F.arrays_zip("asked", "floors"))).select(F.col("asked").alias("id"), F.col("floors").alias("floor"))
    queries = rows.where(is_query).groupBy("id").agg(F.min("vector").alias("vector"), F.count("*").alias("copies"))
    # Of a repeated id the shards may have asked for another vector than the smallest.
    floor = F.when(F.col("copies") == 1, F.col("floor")).alias("floor")
    queries = queries.join(floors.groupBy("id").agg(F.max("floor").alias("floor")), "id", "left")
    queries = stored(queries.select("id", "vector", floor), "kd-queries")
    total = queries.agg(F.sum(F.size("vector") * 8 + 16)).head()[0] or 0
    blocks = -(-total // block_bytes)
    merged = spark.createDataFrame([], FOUND)
    for number in range(blocks):
        # The share of the ids that hash to it: about block_bytes.
        share = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow().combine_chunks()
        held = {}
        for batch in share.to_batches():
            ids, known = np.asarray(batch.column("id")), batch.column("floor").to_pylist()
            for dim, at, asked in _grouped(batch, scale):
                held[dim] = ids[at], asked, [known[i] for i in at]
        found = search(shards, k, spark.sparkContext.broadcast(held))
        merged = merged.unionByName(stored(found, "kd-found") if blocks > 1 else found)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
