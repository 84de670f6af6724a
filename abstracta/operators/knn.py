"""Exact k-nearest-neighbour joins.

Every plan here scores vectors in blocks inside a task and lets a task emit at most k rows
per query, so the pairs themselves never become rows:

* few queries (size checked): the queries are broadcast, the corpus is scanned where it
  lies and never shuffled;
* more queries: both sides are hashed into blocks of bounded size by row, each pair of
  blocks is one task, and the k best per query and block meet in a group limit.

Inside a task the queries are taken in tiles, each with its own candidates, so what a task
holds follows from the size of a tile and not from the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from abstracta.functions.vectors import SPACES
from abstracta.operators.embed import embed_text, evaluated_once, hashed_tokens
from abstracta.operators.ranking import topk_per_group
from abstracta.session import checkpointed

BROADCAST_BYTES = 64 * 1024 * 1024
#: More queries than these meet the corpus in blocks, whose tasks are cut by pairs.
SCAN_QUERIES = 8_192
BLOCK_BYTES = 128 * 1024 * 1024
BLOCK_QUERIES, BLOCK_ITEMS = 32_768, 131_072
#: Rows of sparse vectors are far larger than their count tells.
SPARSE_ITEMS = 50_000
BROADCAST_CELLS = 500_000
#: Candidates that one task may hold, as queries times k.
HELD_CANDIDATES = 1_000_000
MERGE_PARTS = 16
#: Products that a task is worth starting for, and that it computes at most (pairs times values).
TASK_PRODUCTS = 1 << 30, 1 << 38
TASKS_PER_CORE = 4
#: Small cells share tasks of such a part of what a task takes.
SHARED_PARTS = 4
TILE_QUERIES, TILE_CELLS, TILE_CANDIDATES = 1_024, 4_194_304, 400_000
#: Tiles that meet a slice of items one after the other.
TILES = 4
_STEP_CELLS = 524288
_SMALL_BLOCK = 4_096


def to_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Float64 rows from a vector column.

    Reads dense ``list<float>``, sparse ``list<struct<bucket, weight>>`` and plain text,
    which is embedded as hashed term counts on the way.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        rows, buckets = hashed_tokens(column, dim)
        return np.bincount(rows * dim + buckets, minlength=len(column) * dim).astype(np.float64).reshape(-1, dim)
    values = column.flatten()
    lengths = np.diff(column.offsets.to_numpy())
    if pa.types.is_floating(values.type):
        if len(lengths) and not (lengths == dim).all():
            raise ValueError(f"expected vectors of {dim} values")
        return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    buckets = values.field("bucket").to_numpy(zero_copy_only=False)
    weights = values.field("weight").to_numpy(zero_copy_only=False)
    cells = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths) * dim + buckets
    return np.bincount(cells, weights, minlength=len(lengths) * dim).astype(np.float64).reshape(-1, dim)


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def _few_set(mask: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a mask with few cells set: eight are passed over at a time."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    at = (np.flatnonzero(flat.view(np.uint64) != 0)[:, None] * 8 + np.arange(8)).reshape(-1)
    return at[flat[at]]


class Side:
    """Vectors of one side of a block, prepared once for all the blocks they are in."""

    def __init__(self, rows: np.ndarray, space: str):
        self.space, self.known = space, np.isfinite(rows.sum(axis=1))
        self.rows = _unit(rows) if space == "cosine" else rows
        self.squares = None if space == "cosine" else np.einsum("ij,ij->i", rows, rows)
        self._single: dict[bool, np.ndarray] = {}

    def take(self, at: np.ndarray | slice) -> Side:
        part = object.__new__(Side)
        part._single = {}
        part.space, part.known, part.rows = self.space, self.known[at], self.rows[at]
        part.squares = None if self.squares is None else self.squares[at]
        return part

    def to(self, items: Side) -> np.ndarray:
        block = self.rows @ items.rows.T
        if self.space == "cosine":
            block = np.subtract(1.0, block, out=block)
        else:
            block *= -2.0
            block += self.squares[:, None]
            block += items.squares[None, :]
            block = np.maximum(block, 0.0, out=block)
        if not (self.known.all() and items.known.all()):
            block[~self.known, :] = np.inf
            block[:, ~items.known] = np.inf
        return block

    def near(self, items: Side, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs (row, item row) that may be nearer than each row's ``bound``; none nearer is left out.

        The products are taken in single precision, and the bound is widened by what they may
        be off by. None if the values are too large for that.
        """
        if not items.known.any() or not self.known.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        base, room = 1.0, 1.0
        if self.space != "cosine":
            largest = items.squares[items.known].max()
            if not max(largest, self.squares[self.known].max()) < 1e30:
                return None
            base, room = self.squares, 2.0 * np.sqrt(self.squares * largest) + largest
        edge = bound - base
        edge = edge + (self.rows.shape[1] + 8) * 2.0**-23 * (room + np.abs(edge))
        mask = self._in_single(True) @ items._in_single(False).T < np.where(self.known, edge, -np.inf).astype(np.float32)[:, None]
        if not items.known.all():
            mask[:, ~items.known] = False
        return np.divmod(_few_set(mask), mask.shape[1])

    def _in_single(self, asks: bool) -> np.ndarray:
        """Rows whose products are the distances but for what a query adds to all of its own."""
        if asks not in self._single:
            rows = self.rows if self.known.all() else np.where(self.known[:, None], self.rows, 0.0)
            if self.space == "cosine":
                rows = -rows if asks else rows
            else:
                rows = np.c_[-2.0 * rows, np.ones(len(rows))] if asks else np.c_[rows, np.where(self.known, self.squares, 0.0)]
            self._single[asks] = rows.astype(np.float32)
        return self._single[asks]

    def beside(self, items: Side, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Distances of single pairs of usable vectors, as ``to`` has them."""
        products = np.einsum("ij,ij->i", self.rows[row], items.rows[column])
        if self.space == "cosine":
            return 1.0 - products
        return np.maximum(self.squares[row] + items.squares[column] - 2.0 * products, 0.0)


def distances(queries: np.ndarray, items: np.ndarray, space: str) -> np.ndarray:
    """Distance of every query to every item of one block.

    A zero vector is at cosine distance 1; one with a NaN or infinite value is infinitely far.
    """
    return Side(queries, space).to(Side(items, space))


def pair_distances(queries: np.ndarray, items: np.ndarray, space: str) -> np.ndarray:
    """Distance of each query row to the item row beside it."""
    known = np.isfinite(queries.sum(axis=1) + items.sum(axis=1))
    if space == "l2sq":
        return np.where(known, np.square(queries - items).sum(axis=1), np.inf)
    lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries) * np.einsum("ij,ij->i", items, items))
    products = np.einsum("ij,ij->i", queries, items)
    return np.where(known, 1.0 - np.divide(products, lengths, out=np.zeros_like(products), where=lengths > 0), np.inf)


def distance_to(vector: Column, query: Sequence[float], space: str = "cosine") -> Column:
    """Distance of a vector column to one known vector, in Arrow batches."""
    if space not in SPACES:
        raise ValueError(f"Unknown space: {space}")
    target = np.array([query], dtype=np.float64)

    @F.arrow_udf(T.DoubleType())
    def measure(column: pa.Array) -> pa.Array:
        # NULL vectors have no distance; they are left out of the matrix and put back.
        known = column.drop_null()
        found = np.full(len(column), np.nan)
        present = column.is_valid().to_numpy(zero_copy_only=False)
        found[present] = distances(target, to_matrix(known, target.shape[1]), space)[0]
        return pa.array(found, mask=~present)

    return evaluated_once(measure)(vector)


def _by_distance(query: np.ndarray, rounded: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """``lexsort((ids, rounded, query))``, by one number where it fits; only ties are sorted by id."""
    least = rounded.min()
    span = rounded.max() - least + 1.0
    if not (int(query.max()) + 1) * span < 2.0**52:
        return np.lexsort((ids, rounded, query))
    key = (query * span + (rounded - least)).astype(np.int64)
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    among = order[tied]
    order[tied] = among[np.lexsort((ids[among], key[among]))]
    return order


class KBest:
    """The k best (distance to ``digits`` digits, then id) per query over a stream of blocks."""

    #: No (query, id) pair is offered twice.
    distinct = False

    def __init__(self, n_queries: int, k: int, digits: int):
        self.k, self.scale = k, 10.0**digits
        self.worst = np.full(n_queries, np.inf)
        self.last: np.ndarray | None = None  # id of the kth, where there is one
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.room = 4 * n_queries * k + 20_000
        self.settle_at = n_queries * k

    def offer(self, block: np.ndarray, ids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """Take in the distances of ``ids`` to all queries, or to the ``queries`` rows only.

        A (query, id) pair that is offered again is kept once.
        """
        if queries is None:
            queries = np.arange(len(self.worst))
        limit = self.worst[queries]
        open_ended = bool(np.isinf(limit).any())
        if open_ended and block.shape[1] > self.k:
            limit = np.minimum(limit, self._rounded(np.partition(block, self.k - 1, axis=1)[:, self.k - 1]))
        # One comparison leaves few pairs; only those are rounded.
        row, column = np.divmod(np.flatnonzero(block < ((limit + 1.0) / self.scale)[:, None]), block.shape[1])
        dist = block[row, column]
        query, ids = queries[row], ids[column]
        keep = (self._rounded(dist) <= limit[row]) & self._before_last(query, ids, dist)
        self._hold(query[keep], ids[keep], dist[keep], open_ended)

    def search(self, asked: Side, items: Side, ids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """As ``offer``, from the vectors: with k found, only pairs that may come in are measured."""
        limit = self.worst if queries is None else self.worst[queries]
        bound, found = (limit + 1.0) / self.scale, None
        if not (np.isinf(limit) & asked.known).any():
            found = asked.near(items, np.where(asked.known, bound, 0.0))
        if found is None or len(found[0]) > len(limit) * len(ids) // 16:
            self.offer(asked.to(items), ids, queries)
            return
        row, column = found
        dist = asked.beside(items, row, column)
        self.offer_pairs(row if queries is None else queries[row], ids[column], dist)

    def _before_last(self, query: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> np.ndarray | bool:
        """As far away as the kth, an item comes in by a smaller id only (or as its nearer row)."""
        return True if self.last is None else (self._rounded(dist) < self.worst[query]) | (ids <= self.last[query])

    def _rounded(self, dist: np.ndarray) -> np.ndarray:
        return np.floor(dist * self.scale + 0.5)

    def _hold(self, query: np.ndarray, ids: np.ndarray, dist: np.ndarray, settle: bool = False) -> None:
        self.pending.append((query, ids, dist))
        self.held += len(query)
        # A first compaction soon gives limits that later blocks are compared with.
        if self.held > self.room or (settle and self.held >= self.settle_at):
            self._compact()
            self.settle_at = 2 * self.held

    def offer_pairs(self, queries: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        """Take in single (query row, id, distance) pairs."""
        keep = np.isfinite(dist) & (self._rounded(dist) <= self.worst[queries]) & self._before_last(queries, ids, dist)
        self._hold(queries[keep], ids[keep], dist[keep])

    def _compact(self) -> None:
        query, ids, dist = (np.concatenate(parts) for parts in zip(*self.pending))
        if not len(query):
            return
        if not self.distinct:
            order = np.lexsort((dist, ids, query))
            repeated = (np.diff(query[order]) == 0) & (ids[order][1:] == ids[order][:-1])
            order = order[np.r_[True, ~repeated]]
            query, dist, ids = query[order], dist[order], ids[order]
        rounded = self._rounded(dist)
        order = _by_distance(query, rounded, ids)
        sorted_query = query[order]
        starts = np.r_[0, np.nonzero(np.diff(sorted_query))[0] + 1]
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        best = order[rank < self.k]
        full = order[rank == self.k - 1]
        self.worst[query[full]] = rounded[full]
        self.last = np.zeros(len(self.worst), ids.dtype)
        self.last[query[full]] = ids[full]
        self.pending = [(query[best], ids[best], dist[best])]
        self.held = len(best)

    def batch(self, query_ids: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if not self.pending:
            return
        self._compact()
        query, ids, dist = self.pending[0]
        if not len(query):
            return
        # NumPy holds texts at the width of the longest, Arrow takes them one by one.
        found = pa.array(ids if ids.dtype.kind in "iu" else ids.tolist())
        columns = [query_ids.take(pa.array(query)), found, pa.array(dist, pa.float64())]
        yield pa.RecordBatch.from_arrays(
            [column.cast(field.type) for column, field in zip(columns, schema)], schema=schema
        )


def id_array(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    return np.array(column.to_pylist(), dtype=np.str_)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(f.name, types[f.dataType.simpleString()]) for f in schema])


def result_schema(queries: DataFrame, query_id: str, corpus: DataFrame, item_id: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema[query_id].dataType),
            T.StructField("id", corpus.schema[item_id].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def ordered(pairs: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Merge the per-task candidates: the k best per query with their rank.

    Rounds as the tasks did, so a merge cannot prefer what a task would have dropped.
    """
    return topk_per_group(pairs, ["query_id"], [_rounded_to(digits), F.col("id")], k)


def _rounded_to(digits: int) -> Column:
    return F.floor(F.col("distance") * F.lit(10.0**digits) + F.lit(0.5))


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    dim: int,
    space: str = "cosine",
    *,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    item_id: str = "id",
    item_vector: str = "embedding",
    cells: str | None = None,
    digits: int = 6,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
    block_items: int = BLOCK_ITEMS,
    held: int = HELD_CANDIDATES,
) -> DataFrame:
    """``k`` nearest corpus rows of each query: ``query_id, id, distance, rank``.

    Ranks by distance to ``digits`` digits, then id, so results do not depend on the order
    of additions or of tasks. Rows without a vector and corpus rows without an id are left
    out, as are vectors with a NaN or infinite value; of a repeated id the nearest row counts.
    ``k`` below 1 finds nothing. ``cells`` names an
    ``array<bigint>`` column of both sides and restricts the search to pairs that share a
    cell.
    """
    if space not in SPACES:
        raise ValueError(f"Unknown space: {space}")
    # Fresh names on both sides: a self join would otherwise share column identities, and
    # the cogroup drops columns it takes for the same.
    q = queries.where(F.col(query_vector).isNotNull()).select(
        F.col(query_id).alias("q_id"),
        F.col(query_vector).alias("q_vector"),
        *([F.col(cells).alias("q_cells")] if cells else []),
    )
    c = corpus.where(F.col(item_vector).isNotNull() & F.col(item_id).isNotNull()).select(
        F.col(item_id).alias("c_id"),
        F.col(item_vector).alias("c_vector"),
        *([F.col(cells).alias("c_cells")] if cells else []),
    )
    if isinstance(q.schema["q_vector"].dataType, T.StringType):
        # As terms, a query of any length has a bounded size.
        q = _embedded(q, "q_vector", dim)
    schema = result_schema(queries, query_id, corpus, item_id)
    vector_type = c.schema["c_vector"].dataType
    dense = isinstance(vector_type, T.ArrayType) and not isinstance(vector_type.elementType, T.StructType)
    if int(k) < 1:
        return queries.sparkSession.createDataFrame([], T.StructType([*schema, T.StructField("rank", T.IntegerType(), False)]))
    row_bytes = dim * 8
    n_queries, most = q.count(), max(1, held // int(k))
    if n_queries <= min(SCAN_QUERIES, most, broadcast_bytes // row_bytes):
        pairs = _scan(q.toArrow(), c, int(k), dim, space, digits, schema)
    else:
        block_queries = max(1, min(BLOCK_QUERIES, most, block_bytes // row_bytes))
        # Dense items are held as they travel, in single precision mostly.
        block_items = max(1, min(block_items, BLOCK_BYTES // (4 * dim) if dense else SPARSE_ITEMS))
        pairs = _blocks(q, c, n_queries, int(k), dim, space, digits, schema, block_queries, block_items)
    # Two tasks may have met the same pair: in different cells, or by a repeated id.
    if n_queries >= int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        # There is work for all tasks by query: one exchange serves both the pairs and the ranking.
        once = pairs.repartition("query_id").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
        return ordered(once, k, digits)
    # Few queries, each with up to k candidates per task: merged in parts by id before they meet.
    parts = pairs.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(MERGE_PARTS))).repartition("query_id", "_part")
    once = parts.groupBy("query_id", "_part", "id").agg(F.min("distance").alias("distance"))
    best = topk_per_group(once, ["query_id", "_part"], [_rounded_to(digits), F.col("id")], int(k)).drop("_part", "rank")
    return ordered(best, k, digits)


def _embedded(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    return embed_text(rows, vector, dim, "_terms").drop(vector).withColumnRenamed("_terms", vector)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, and the end."""
    return np.r_[np.nonzero(np.r_[True, ordered[1:] != ordered[:-1]])[0], len(ordered)] if len(ordered) else np.zeros(1, int)


def _members(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct cells of an ``array<bigint>`` column and the rows in each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    values = column.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(values, kind="stable")
    found, starts = np.unique(values[order], return_index=True)
    return found, np.split(rows[order], starts[1:])


def _steps(n_queries: int, n_items: int, dim: int) -> Iterator[tuple[int, int]]:
    """(start, length) of item slices small enough to score against all queries at once."""
    step = max(1, _STEP_CELLS // max(dim, n_queries, 1))
    for start in range(0, n_items if n_queries else 0, step):
        yield start, step


def _tile(k: int, dim: int) -> int:
    """Queries whose vectors and candidates are held at a time."""
    return max(1, min(TILE_QUERIES, TILE_CELLS // dim, TILE_CANDIDATES // k))


def _offer_cells(
    best: KBest, asked: Side, matrix: np.ndarray, items: np.ndarray, ids: np.ndarray, cells: pa.Array,
    probes: dict[int, np.ndarray],
) -> None:
    """Score each item against the queries that search one of its cells.

    Cells with many pairs are multiplied as blocks; the pairs of all small cells are scored
    together.
    """
    few: list[tuple[np.ndarray, np.ndarray]] = []
    prepared = Side(items, asked.space)
    for cell, rows in zip(*_members(cells)):
        asking = probes.get(cell)
        if asking is None:
            continue
        if len(asking) * len(rows) < _SMALL_BLOCK:
            few.append((np.repeat(asking, len(rows)), np.tile(rows, len(asking))))
            continue
        for first in range(0, len(asking), TILE_QUERIES):
            tile = asking[first : first + TILE_QUERIES]
            known = asked.take(tile)
            for start, step in _steps(len(tile), len(rows), matrix.shape[1]):
                part = rows[start : start + step]
                best.search(known, prepared.take(part), ids[part], tile)
    for q, r in _pieces(few, matrix.shape[1]):
        best.offer_pairs(q, ids[r], pair_distances(matrix[q], items[r], asked.space))


def _pieces(few: list[tuple[np.ndarray, np.ndarray]], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of many small cells, a bounded number at a time."""
    queries, rows = (np.concatenate(side) for side in zip(*few)) if few else ((), ())
    step = max(1, _STEP_CELLS // dim)
    for start in range(0, len(rows), step):
        yield queries[start : start + step], rows[start : start + step]


def _scan(
    queries: pa.Table, corpus: DataFrame, k: int, dim: int, space: str, digits: int, schema: T.StructType
) -> DataFrame:
    """Score the corpus where it lies against broadcast queries."""
    out = _arrow_schema(schema)
    celled = "c_cells" in corpus.columns
    probes = dict(zip(*(part for part in _members(queries.column("q_cells"))))) if celled else {}
    if celled and len(probes) <= 1000:
        wanted = F.array(*[F.lit(int(cell)) for cell in probes]).cast("array<bigint>")
        corpus = corpus.where(F.arrays_overlap("c_cells", wanted))
    shared = corpus.sparkSession.sparkContext.broadcast(
        (queries.column("q_id").combine_chunks(), to_matrix(queries.column("q_vector"), dim), probes)
    )
    tile = _tile(k, dim)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix, probed = shared.value
        asked = Side(matrix, space)
        if celled:
            best = KBest(len(matrix), k, digits)
            for batch in batches:
                # Cells are cut further inside.
                for start, step in _steps(min(len(matrix), 1), batch.num_rows, dim):
                    part = batch.slice(start, step)
                    items, ids = to_matrix(part.column(1), dim), id_array(part.column(0))
                    _offer_cells(best, asked, matrix, items, ids, part.column(2), probed)
            yield from best.batch(query_ids, out)
            return
        at = [slice(start, start + tile) for start in range(0, len(matrix), tile)]
        tiles = [asked.take(rows) for rows in at]
        bests = [KBest(len(known.rows), k, digits) for known in tiles]
        for batch in batches:
            for start, step in _steps(min(len(matrix), tile), batch.num_rows, dim):
                part = batch.slice(start, step)
                items, ids = Side(to_matrix(part.column(1), dim), space), id_array(part.column(0))
                for known, best in zip(tiles, bests):
                    best.search(known, items, ids)
        for rows, best in zip(at, bests):
            yield from best.batch(query_ids[rows], out)

    return corpus.mapInArrow(scan, schema)


def _blocks(
    queries: DataFrame, corpus: DataFrame, n_queries: int, k: int, dim: int, space: str, digits: int,
    schema: T.StructType, block_queries: int, block_items: int,
) -> DataFrame:
    """Blocked join of two large sides; block counts follow the counted rows.

    A cell (all rows, where there are no cells) is cut into blocks of both sides, a task for
    each pair of them: as many as keep all cores busy, none above ``TASK_PRODUCTS``. So a hot
    cell is many tasks and not one. Small cells share tasks.
    Texts are embedded before they are copied to several blocks.
    """
    if isinstance(corpus.schema["c_vector"].dataType, T.StringType):
        corpus = _embedded(corpus, "c_vector", dim)
    tasks_wanted = TASKS_PER_CORE * corpus.sparkSession.sparkContext.defaultParallelism
    if "c_cells" in corpus.columns:
        queries = queries.withColumn("_cell", F.explode("q_cells")).drop("q_cells")
        corpus = corpus.withColumn("_cell", F.explode("c_cells")).drop("c_cells")
        q_counts = queries.groupBy("_cell").agg(F.count("*").alias("n_q"))
        sizes = checkpointed(q_counts.join(corpus.groupBy("_cell").agg(F.count("*").alias("n_c")), "_cell"))
        n_cells, pairs = sizes.agg(F.count("*"), F.sum(F.col("n_q").cast("double") * F.col("n_c"))).head()
        most = _task_pairs(pairs or 0, tasks_wanted, dim)
        sizes, tasks = _dealt(sizes, most, block_queries, block_items, TASK_PRODUCTS[0] // dim)
        sizes = F.broadcast(sizes) if n_cells <= BROADCAST_CELLS else sizes
        queries, corpus = queries.join(sizes, "_cell"), corpus.join(sizes, "_cell")
    else:
        n_items = corpus.count()
        most = _task_pairs(n_queries * n_items, tasks_wanted, dim)
        q_blocks, c_blocks = _cuts(n_queries, n_items, most, block_queries, block_items)
        whole = {"_cell": F.lit(0), "_q_blocks": F.lit(q_blocks), "_c_blocks": F.lit(c_blocks), "_first": F.lit(0)}
        queries, corpus, tasks = queries.withColumns(whole), corpus.withColumns(whole), q_blocks * c_blocks

    def numbered(blocks: str, *row: str) -> Column:
        # The whole row is hashed, so equal vectors spread as long as their ids differ.
        return F.pmod(F.xxhash64(*row), F.col(blocks)).cast("int")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    left = queries.withColumn("_q", numbered("_q_blocks", "q_id", "q_vector")).withColumn("_c", every("_c_blocks"))
    right = corpus.withColumn("_c", numbered("_c_blocks", "c_id", "c_vector")).withColumn("_q", every("_q_blocks"))
    task = (F.col("_first") + F.col("_q") * F.col("_c_blocks") + F.col("_c")).cast("int").alias("_task")
    left = left.select(task, "_cell", "q_id", "q_vector").repartitionById(tasks, F.col("_task"))
    right = right.select(task, "_cell", "c_id", "c_vector").repartitionById(tasks, F.col("_task"))
    out, tile = _arrow_schema(schema), _tile(k, dim)

    def join(q: pa.Table, c: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_joined(q, c, k, dim, space, digits, tile, out), out)

    return left.groupBy("_task").cogroup(right.groupBy("_task")).applyInArrow(join, schema)


def _task_pairs(pairs: float, tasks: int, dim: int) -> int:
    """Pairs of one task: enough to start it for, few enough to end soon, and work for all cores."""
    least, most = (max(1, products // dim) for products in TASK_PRODUCTS)
    return int(max(least, min(most, pairs / tasks)))


def _cuts(n_queries: int, n_items: int, most: int, block_queries: int, block_items: int) -> tuple[int, int]:
    """Blocks of both sides, such that a pair of them has about ``most`` pairs of rows at most."""
    block_queries = max(1, min(block_queries, most // max(1, min(n_items, block_items))))
    return max(1, -(-n_queries // block_queries)), max(1, -(-n_items // block_items))


def _dealt(
    sizes: DataFrame, most: int, block_queries: int, block_items: int, least: int = 1
) -> tuple[DataFrame, int]:
    """``_cell, _q_blocks, _c_blocks, _first`` (the cell's first task), and the number of tasks.

    Cells that would be felt in a shared task (over a quarter of what a task takes) have tasks of
    their own. Only they are listed by the driver: no more than four times the tasks a full deal needs.
    The others meet by hash, a quarter of a task at a time, so that a few too many in one are no matter.
    A task is not worth starting for under ``least`` pairs.
    """
    pairs = F.col("n_q").cast("double") * F.col("n_c")
    some_queries, some_items = -(-block_queries // SHARED_PARTS), -(-block_items // SHARED_PARTS)
    some_pairs = min(most, max(least, -(-most // SHARED_PARTS)))
    large = (F.col("n_q") > some_queries) | (F.col("n_c") > some_items) | (pairs > some_pairs)
    cut, first = [], 0
    for cell, n_q, n_c in sizes.where(large).select("_cell", "n_q", "n_c").collect():
        q_blocks, c_blocks = _cuts(n_q, n_c, most, block_queries, block_items)
        cut.append((cell, q_blocks, c_blocks, first))
        first += q_blocks * c_blocks
    n_q, n_c, rest = sizes.where(~large).agg(F.sum("n_q"), F.sum("n_c"), F.sum(pairs)).head()
    shared = 0 if n_q is None else max(1, -(-n_q // some_queries), -(-n_c // some_items), -(-int(rest) // some_pairs))
    at_hash = (F.pmod(F.xxhash64("_cell"), F.lit(max(1, shared))) + first).cast("int")
    small = sizes.where(~large).select("_cell", F.lit(1).alias("_q_blocks"), F.lit(1).alias("_c_blocks"), at_hash.alias("_first"))
    listed = sizes.sparkSession.createDataFrame(cut, small.schema)
    return small.unionByName(listed), max(1, first + shared)


def _by_cell(side: pa.Table) -> tuple[pa.Table, dict[int, tuple[int, int]]]:
    """Rows in order of their cell, and where each cell begins and ends."""
    cells = side.column("_cell").to_numpy()
    if len(cells) and (cells != cells[0]).any():
        order = np.argsort(cells, kind="stable")
        side, cells = side.take(pa.array(order)), cells[order]
    starts = _starts(cells)
    return side, {int(cells[start]): (int(start), int(end)) for start, end in zip(starts, starts[1:])}


def _joined(
    q: pa.Table, c: pa.Table, k: int, dim: int, space: str, digits: int, tile: int, out: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """The k best of each query and cell of one task, a tile of queries at a time."""
    q, asked = _by_cell(q)
    c, held = _by_cell(c)
    query_ids, vectors = q.column("q_id").combine_chunks(), q.column("q_vector")
    few: list[tuple[int, int, int, int]] = []
    for cell in asked.keys() & held.keys():
        (q_start, q_end), (c_start, c_end) = asked[cell], held[cell]
        if (q_end - q_start) * (c_end - c_start) < _SMALL_BLOCK:
            few.append((q_start, q_end, c_start, c_end))
            continue
        distinct = len(np.unique(id_array(c.column("c_id").slice(c_start, c_end - c_start)))) == c_end - c_start
        for first in range(q_start, q_end, tile * TILES):
            # Some tiles meet each slice of items while it is at hand.
            at = [(start, min(tile, q_end - start)) for start in range(first, min(q_end, first + tile * TILES), tile)]
            tiles = [Side(to_matrix(vectors.slice(*rows), dim), space) for rows in at]
            bests = [KBest(n, k, digits) for _, n in at]
            for best in bests:
                best.distinct = distinct
            for start, step in _steps(at[0][1], c_end - c_start, dim):
                part = c.slice(c_start + start, min(step, c_end - c_start - start))
                items, ids = Side(to_matrix(part.column("c_vector"), dim), space), id_array(part.column("c_id"))
                for known, best in zip(tiles, bests):
                    best.search(known, items, ids)
            for rows, best in zip(at, bests):
                yield from best.batch(query_ids.slice(*rows), out)
    # Small cells are taken together, as many at a time as fill a step.
    room = max(1, _STEP_CELLS // dim)
    while few:
        some, rows = [], 0
        while few and (not some or rows < room):
            some.append(few.pop())
            rows += max((some[-1][1] - some[-1][0]) * (some[-1][3] - some[-1][2]), 1)
        yield from _few(some, query_ids, vectors, c, k, dim, space, digits, out)


def _few(
    cells: list[tuple[int, int, int, int]], query_ids: pa.Array, vectors: pa.ChunkedArray, c: pa.Table,
    k: int, dim: int, space: str, digits: int, out: pa.Schema,
) -> Iterator[pa.RecordBatch]:
    """All pairs inside small cells, scored row beside row."""
    q_rows = np.concatenate([np.arange(start, end) for start, end, _, _ in cells])
    c_rows = np.concatenate([np.arange(start, end) for _, _, start, end in cells])
    items = c.take(pa.array(c_rows))
    matrix, found, ids = (
        to_matrix(vectors.take(pa.array(q_rows)), dim), to_matrix(items.column("c_vector"), dim), id_array(items.column("c_id"))
    )
    pairs, q_at, c_at = [], 0, 0
    for q_start, q_end, c_start, c_end in cells:
        n, m = q_end - q_start, c_end - c_start
        pairs.append((np.repeat(np.arange(q_at, q_at + n), m), np.tile(np.arange(c_at, c_at + m), n)))
        q_at, c_at = q_at + n, c_at + m
    best = KBest(len(q_rows), k, digits)
    for at, r in _pieces(pairs, dim):
        best.offer_pairs(at, ids[r], pair_distances(matrix[at], found[r], space))
    yield from best.batch(query_ids.take(pa.array(q_rows)), out)
