"""The stored inverted file: two-level centroids, loads by cell, searches of probed folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from abstracta.operators import cell_tree
from abstracta.operators.ann import ann_recall
from abstracta.operators.embed import hashed_dense_model, register_model
from abstracta.operators.knn import distances, knn_join
from abstracta.plans import index
from abstracta.plans.search import search_cells, search_collection, tune_cells
from abstracta.session import table

DIM = 64


def rows_of(spark, sf="0.01"):
    e = table(spark, f"/root/testdata/sf{sf}", "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.lit("d").alias("document"), F.lit(None).cast("map<string,string>").alias("metadata"), "embedding")


def nearest_by_hand(vector, centroids, groups, n, breadth):
    def rank(candidates, key):
        matrix = np.array([c[key] for c in candidates])
        return np.floor(distances(np.array([vector], float), matrix, "cosine")[0] * 1e6 + 0.5)

    groups = sorted(groups, key=lambda g: g["grp"])
    wide = {groups[i]["grp"] for i in np.argsort(rank(groups, "center"), kind="stable")[:breadth]}
    inside = sorted((c for c in centroids if c["grp"] in wide), key=lambda c: c["cell"])
    return [inside[i]["cell"] for i in np.argsort(rank(inside, "centroid"), kind="stable")[:n]]


@pytest.fixture(scope="module")
def tree(spark):
    return cell_tree.grow(rows_of(spark), 32, DIM)


def test_recall_of_a_trained_store_and_folders_read(spark, tree, tmp_path):
    root, rows = str(tmp_path / "v"), rows_of(spark)
    index.create_store(spark, root)
    index.store_cells(root, "m", tree)
    even = F.col("id").cast("int") % 2 == 0
    for load, part in (("a", rows.where(even)), ("b", rows.where(~even)), ("b", rows.where(~even))):
        index.index_append(part, root, "m", lambda r: r, load)
    stored = index.open_collection(spark, root, "m")
    assert stored.count() == rows.count() and stored.where("cell = -1").count() == 0
    assert 20 <= stored.select("cell").distinct().count() <= 48
    queries = rows.where(F.col("id").cast("int") % 10 == 0).withColumnRenamed("id", "query_id")
    probes = tune_cells(spark, root, "m", recall=0.92)
    found = search_cells(spark, root, "m", queries, 10)
    exact = knn_join(queries, rows, 10, DIM)
    recall = ann_recall(exact, found).agg(F.avg("recall")).head()[0]
    print(f"recall at 10, {probes} of {tree.centroids.count()} cells probed: {recall:.3f}")
    assert recall >= 0.9 and probes < tree.centroids.count()
    # All cells probed: the exact result.
    every = search_cells(spark, root, "m", queries, 10, nprobe=1000, breadth=1000)
    assert sorted(map(tuple, every.select("query_id", "id", "rank").collect())) == sorted(map(tuple, exact.select("query_id", "id", "rank").collect()))


def test_plan_reads_probed_folders_only(spark, tree, tmp_path):
    root = str(tmp_path / "v")
    index.create_store(spark, root)
    index.store_cells(root, "m", tree)
    index.index_append(rows_of(spark, "0.001"), root, "m", lambda r: r)
    one = rows_of(spark, "0.001").where("id = '5'").withColumnRenamed("id", "query_id")
    hits = search_cells(spark, root, "m", one, 5, nprobe=2)
    text = hits._jdf.queryExecution().executedPlan().toString()
    filters = text.split("PartitionFilters: ")[1].split("]")[0]
    assert "cell" in filters and "model" in filters
    assert "document" not in text.split("ReadSchema")[1]
    cells = index.open_collection(spark, root, "m").select("id", "cell").collect()
    probed = cell_tree.assigned(one, tree, DIM, 2).head()["cells"]
    assert {r["id"] for r in hits.collect()} <= {r["id"] for r in cells if r["cell"] in probed}


def test_both_ways_of_assigning_equal_the_rule(spark, tree):
    vectors = rows_of(spark, "0.001").limit(60).select("id", "embedding")
    bad = spark.createDataFrame([("null", None), ("nan", [float("nan")] * DIM)], "id string, embedding array<float>")
    vectors = vectors.unionByName(bad)
    centroids, groups = tree.centroids.collect(), tree.groups.collect()
    small = {r["id"]: r["cells"] for r in cell_tree.assigned(vectors, tree, DIM, 3, 2).collect()}
    large = {r["id"]: r["cells"] for r in cell_tree.assigned(vectors, tree, DIM, 3, 2, broadcast_bytes=0).collect()}
    assert set(small) == set(large) and small["null"] is None and large["null"] is None
    for row in vectors.where("id not in ('null', 'nan')").collect():
        assert small[row["id"]] == large[row["id"]] == nearest_by_hand(row["embedding"], centroids, groups, 3, 2)


def test_awkward_collections(spark, tmp_path):
    root = str(tmp_path / "v")
    index.create_store(spark, root)
    empty = rows_of(spark).limit(0)
    nothing = cell_tree.grow(empty, 4, DIM)
    assert nothing.centroids.count() == 0
    index.store_cells(root, "none", nothing)
    same = spark.range(50).select(F.col("id").cast("string").alias("id"), F.array(*[F.lit(1.0)] * 4).cast("array<float>").alias("embedding"))
    same = same.unionByName(spark.createDataFrame([(None, None), ("z", [0.0] * 4)], "id string, embedding array<float>"))
    rows = same.withColumns({"document": F.lit("d"), "metadata": F.lit(None).cast("map<string,string>"), "cell": F.lit("x"), "grp": F.lit("x")})
    tree = cell_tree.grow(rows, 9, 4)  # copies of one vector: one cell
    assert tree.centroids.count() == 1
    index.store_cells(root, "m", tree)
    index.index_append(rows, root, "m", lambda r: r)
    index.index_append(empty, root, "m", lambda r: r)
    stored = index.open_collection(spark, root, "m")
    assert stored.count() == 52 and stored.where("id is null").count() == 0
    asked = spark.createDataFrame([(1, [1.0, 1.0, 1.0, 1.0]), (2, None)], "query_id long, embedding array<float>")
    hits = search_cells(spark, root, "m", asked, 3).collect()
    assert [(r["query_id"], r["id"]) for r in hits] == [(1, "0"), (1, "1"), (1, "10")]
    assert tune_cells(spark, root, "m") == 1
    with pytest.raises(ValueError, match="No cells"):
        search_cells(spark, root, "other", asked, 3)
    with pytest.raises(ValueError, match="No cells"):
        tune_cells(spark, root, "other")


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    """Vectors around 40 directions: a handful of cells holds the neighbours."""
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((40, 16))
    data = (centers[rng.integers(0, 40, 1200)] + 0.15 * rng.standard_normal((1200, 16))).tolist()
    rows = spark.createDataFrame([(str(i), v) for i, v in enumerate(data)], "id string, embedding array<float>")
    rows = rows.withColumns({"document": F.lit("d"), "metadata": F.lit(None).cast("map<string,string>")})
    root = str(tmp_path / "v")
    index.create_store(spark, root)
    index.store_cells(root, "m", cell_tree.grow(rows, 40, 16))
    index.index_append(rows, root, "m", lambda r: r)
    probes = tune_cells(spark, root, "m", recall=0.95)
    queries = rows.where(F.col("id").cast("int") % 12 == 0).withColumnRenamed("id", "query_id")
    recall = ann_recall(knn_join(queries, rows, 10, 16), search_cells(spark, root, "m", queries, 10)).agg(F.avg("recall")).head()[0]
    print(f"clustered: {probes} of 40 cells, recall {recall:.3f}")
    assert probes <= 8 and recall >= 0.93


def test_text_search_of_a_stored_model_by_cells(spark, tmp_path):
    root, model = str(tmp_path / "v"), register_model(hashed_dense_model(32))
    index.create_store(spark, root)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"), F.lit(None).cast("map<string,string>").alias("metadata"))
    embed = index.model_embedder(model.name)
    index.store_cells(root, model.name, cell_tree.grow(embed(rows), 8, 32))
    index.index_append(rows, root, model.name, embed)
    queries = table(spark, "/root/testdata/sf0.001", "benchmark").withColumnRenamed("item_id", "query_id")
    exact = search_collection(spark, root, model.name, queries, 5, dense=True)
    probed = search_collection(spark, root, model.name, queries, 5, dense=True, nprobe=1000)
    assert probed.count() > 0
    assert ann_recall(exact, probed).agg(F.avg("recall")).head()[0] >= 0.9
