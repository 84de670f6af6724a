"""What a task of a k-NN join holds and computes."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from abstracta.operators import ann, embed, knn

OUT = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def side(points, cells, ids, name):
    vectors = pa.array([[float(x) for x in p] for p in points], pa.list_(pa.float32()))
    return pa.table({"_cell": pa.array(cells, pa.int64()), f"{name}_id": pa.array(ids, pa.int64()), f"{name}_vector": vectors})


def brute(q, c, k, space, same=None):
    q, c = q.astype(np.float32).astype(np.float64), c.astype(np.float32).astype(np.float64)
    if space == "cosine":
        far = 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    else:
        far = np.square(q[:, None] - c[None]).sum(-1)
    found = set()
    for i, row in enumerate(np.floor(far * 1e6 + 0.5)):
        near = [j for j in np.lexsort((np.arange(len(c)), row)) if same is None or same[i, j]]
        found |= {(i, int(j)) for j in near[:k]}
    return found


def pairs(batches):
    return {(r["query_id"], r["id"]) for batch in batches for r in batch.to_pylist()}


@pytest.mark.parametrize("space", ["cosine", "l2sq"])
def test_a_task_holds_the_candidates_of_a_tile(monkeypatch, space):
    rng, held = np.random.RandomState(1), []

    class Watched(knn.KBest):
        def __init__(self, n_queries, k, digits):
            held.append(n_queries * k)
            super().__init__(n_queries, k, digits)

    monkeypatch.setattr(knn, "KBest", Watched)
    q, c = rng.standard_normal((700, 8)), np.repeat(rng.standard_normal((450, 8)), 2, axis=0)
    q[3:9] = q[0]
    tables = side(q, [0] * 700, range(700), "q"), side(c, [0] * 900, range(900), "c")
    found = pairs(knn._joined(*tables, 5, 8, space, 6, 100, OUT))
    assert found == brute(q, c, 5, space) and max(held) == 500 and len(held) == 7


def test_a_slice_of_items_is_prepared_once_for_some_tiles(monkeypatch):
    rng, read = np.random.RandomState(6), []
    to_matrix = knn.to_matrix
    monkeypatch.setattr(knn, "to_matrix", lambda column, dim: read.append(len(column)) or to_matrix(column, dim))
    q, c = rng.standard_normal((800, 8)), rng.standard_normal((900, 8))
    found = pairs(knn._joined(side(q, [0] * 800, range(800), "q"), side(c, [0] * 900, range(900), "c"), 5, 8, "cosine", 6, 100, OUT))
    assert found == brute(q, c, 5, "cosine") and sum(read) == 800 + 900 * 2


@pytest.mark.parametrize("scale", [1.0, 1e60])
def test_candidates_in_order(scale):
    rng = np.random.RandomState(7)
    query, ids, rounded = rng.randint(0, 40, 5_000), rng.permutation(5_000), rng.randint(-1, 30, 5_000) * scale
    assert (knn._by_distance(query, rounded, ids) == np.lexsort((ids, rounded, query))).all()


@pytest.mark.parametrize("shape", [(3, 7), (8, 64), (1, 16)])
def test_few_set_cells_are_found(shape):
    mask = np.random.RandomState(8).random_sample(shape) < 0.1
    mask[-1, -1] = True
    assert (knn._few_set(mask) == np.flatnonzero(mask)).all()


def test_an_id_repeated_in_later_slices_counts_once_by_its_nearest_row(monkeypatch):
    monkeypatch.setattr(knn, "_STEP_CELLS", 5_000)  # 100 items beside 50 queries
    rng = np.random.RandomState(9)
    q, c, ids = rng.standard_normal((100, 4)), rng.standard_normal((600, 4)), np.arange(600) % 200
    found = [r for b in knn._joined(side(q, [0] * 100, range(100), "q"), side(c, [0] * 600, ids, "c"), 5, 4, "l2sq", 6, 50, OUT) for r in b.to_pylist()]
    far = np.square(q.astype(np.float32).astype(float)[:, None] - c.astype(np.float32).astype(float)[None]).sum(-1).reshape(100, 3, 200).min(1)
    want = {(i, int(j)) for i, row in enumerate(far) for j in np.lexsort((np.arange(200), np.floor(row * 1e6 + 0.5)))[:5]}
    assert {(r["query_id"], r["id"]) for r in found} == want and len(found) == 500


def test_cells_of_one_task_stay_apart():
    rng = np.random.RandomState(2)
    cells = np.r_[np.zeros(300, int), rng.randint(1, 60, 300)]  # one large, many small ones
    points = rng.standard_normal((600, 8))
    tables = side(points, cells, range(600), "q"), side(points, cells, range(600), "c")
    found = pairs(knn._joined(*tables, 4, 8, "cosine", 6, 100, OUT))
    assert found == brute(points, points, 4, "cosine", cells[:, None] == cells[None])


def test_copies_of_the_kth_are_not_held():
    best = knn.KBest(1, 2, 6)
    best.offer(np.zeros((1, 50)), np.arange(50))
    best._compact()
    for start in range(100, 10_000, 100):
        best.offer(np.zeros((1, 100)), np.arange(start, start + 100))
    assert best.held == 2
    best.offer(np.array([[0.0]]), np.array([-1]))
    best._compact()
    assert best.pending[0][1].tolist() == [-1, 0]


@pytest.mark.parametrize("space, shift", [("cosine", 0.0), ("l2sq", 0.0), ("l2sq", 1000.0)])
def test_no_near_pair_is_lost_in_single_precision(space, shift):
    rng = np.random.RandomState(3)
    q, c = rng.standard_normal((80, 64)) + shift, rng.standard_normal((500, 64)) + shift
    c[5, 3] = np.nan
    known, items = knn.Side(q, space), knn.Side(c, space)
    far = known.to(items)
    bound = np.partition(far, 10, axis=1)[:, 10]
    row, column = known.near(items, bound)
    assert set(zip(*np.nonzero(far < bound[:, None]))) <= set(zip(row, column)) and 5 not in column


def test_cuts_by_pairs():
    most = knn._task_pairs(600_000**2, 48, 64)
    q, c = knn._cuts(600_000, 600_000, most, knn.BLOCK_QUERIES, knn.BLOCK_ITEMS)
    assert q * c >= 48 and -(-600_000 // q) * -(-600_000 // c) <= knn.TASK_PRODUCTS[1] // 64


def test_hot_cells_are_cut_and_small_ones_share_a_task(spark):
    sizes = spark.createDataFrame([(0, 1000, 1000), *((i, 2, 3) for i in range(1, 200))], "_cell long, n_q long, n_c long")
    dealt, tasks = knn._dealt(sizes, 100_000, 10_000, 10_000)
    rows = {r["_cell"]: (r["_q_blocks"], r["_c_blocks"], r["_first"]) for r in dealt.collect()}
    assert tasks == 11 and rows.pop(0) == (10, 1, 0) and set(rows.values()) == {(1, 1, 10)} and len(rows) == 199


def test_cells_that_share_a_task_do_not_overfill_it(spark):
    cells = [(i, 3_000, 3_000) for i in range(60)] + [(i, 40, 40) for i in range(60, 1_000)]
    sizes = spark.createDataFrame(cells, "_cell long, n_q long, n_c long")
    dealt, tasks = knn._dealt(sizes, 20_000_000, 10_000, 10_000)
    rows = {}
    for r in dealt.collect():
        assert (r["_q_blocks"], r["_c_blocks"]) == (1, 1)
        rows[r["_first"]] = rows.get(r["_first"], 0) + (3_000 if r["_cell"] < 60 else 40)
    assert sum(rows.values()) == 60 * 3_000 + 940 * 40 and max(rows) < tasks and max(rows.values()) <= 10_000


def test_many_queries_are_dealt_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(knn, "SCAN_QUERIES", 100)
    monkeypatch.setattr(knn, "TASK_PRODUCTS", (1 << 12, 1 << 13))
    points = np.random.RandomState(4).standard_normal((200, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, embedding array<float>").coalesce(1)
    found = knn.knn_join(rows.withColumnRenamed("id", "query_id"), rows, 3, 4)
    assert {(r["query_id"], r["id"]) for r in found.collect()} == brute(points, points, 3, "cosine")
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "shufflepartitionidpassthrough(direct_shuffle_partition_id(_task" in plan


def test_texts_are_embedded_in_small_slices():
    texts = pa.array(["a b " * 400_000, "b", None] * 3)
    assert [len(part) for part in embed._slices(texts)] == [3, 3, 3]
    assert embed._terms(texts, 64) == pa.concat_arrays([embed._slice_terms(texts.slice(i, 1), 64) for i in range(9)])


def test_a_batch_beside_many_centroids_is_measured_in_slices(monkeypatch):
    monkeypatch.setattr(ann.F, "arrow_udf", lambda kind: lambda function: function)
    rng = np.random.RandomState(5)
    points, centroids = rng.standard_normal((3_000, 8)).astype(np.float32), rng.standard_normal((2_000, 8))
    column = side(points, [0] * 3_000, range(3_000), "q").column("q_vector").combine_chunks()
    assign = ann._nearest_in(SimpleNamespace(value=(np.arange(2_000) * 7, centroids)), 8, 3, "cosine", 6)
    tracemalloc.start()
    found = assign(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(i, near["cell"] // 7) for i, row in enumerate(found.to_pylist()) for near in row} == brute(points, centroids.astype(np.float64), 3, "cosine")
    assert peak < 30_000_000 and len(assign(column.slice(0, 0))) == 0
