"""Operators against brute force and their stated properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from abstracta.operators import ann, clean, joins, ranking, stats
from abstracta.operators.embed import EmbeddingModel, embed_text, get_model, register_model
from abstracta.operators.knn import knn_join
from abstracta.plans.index import unseen
from abstracta.plans.search import search_records, text_topk_search, vector_search

SMALL = {"broadcast_bytes": 0, "block_bytes": 16 * 8 * 7, "block_items": 11}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.RandomState(3)
    points = rng.standard_normal((150, 16)).astype(np.float32)
    points[50:100] = points[0]  # a third of the rows are copies of one vector
    cells = [int(c) for c in rng.randint(0, 4, 150)]
    cells[:90] = [0] * 90  # and one cell holds most rows
    rows = [(f"v{i:03d}", [float(x) for x in p], cells[i]) for i, p in enumerate(points)]
    return points.astype(np.float64), cells, spark.createDataFrame(rows, "id string, embedding array<float>, cell int")


def brute(points, k, space, allowed=None):
    if space == "cosine":
        unit = points / np.linalg.norm(points, axis=1, keepdims=True)
        d = 1 - unit @ unit.T
    else:
        d = ((points[:, None] - points[None]) ** 2).sum(-1)
    result = set()
    for q in range(len(points)):
        items = [i for i in range(len(points)) if allowed is None or allowed[q][i]]
        items.sort(key=lambda i: (np.floor(d[q, i] * 1e6 + 0.5), i))
        result |= {(f"v{q:03d}", f"v{i:03d}", rank + 1) for rank, i in enumerate(items[:k])}
    return result


def hits(frame):
    return {(r["query_id"], r["id"], r["rank"]) for r in frame.collect()}


@pytest.mark.parametrize("space", ["cosine", "l2sq"])
@pytest.mark.parametrize("blocks", [{}, SMALL])
def test_knn_join_is_brute_force(cloud, space, blocks):
    points, _cells, rows = cloud
    found = knn_join(rows.withColumnRenamed("id", "query_id"), rows, 7, 16, space, **blocks)
    assert hits(found) == brute(points, 7, space)


def test_topk_is_a_prefix_of_a_longer_one(cloud):
    _points, _cells, rows = cloud
    queries = rows.withColumnRenamed("id", "query_id")
    short, long = hits(knn_join(queries, rows, 4, 16)), hits(knn_join(queries, rows, 5, 16))
    assert short == {h for h in long if h[2] <= 4}


def test_k_beyond_the_corpus(cloud):
    _points, _cells, rows = cloud
    found = knn_join(rows.limit(2).withColumnRenamed("id", "query_id"), rows, 1000, 16)
    assert found.count() == 2 * 150


def test_empty_sides(spark, cloud):
    _points, _cells, rows = cloud
    none = rows.where("false")
    assert knn_join(none.withColumnRenamed("id", "query_id"), rows, 3, 16).count() == 0
    assert knn_join(rows.withColumnRenamed("id", "query_id"), none, 3, 16).count() == 0


@pytest.mark.parametrize("blocks", [{}, SMALL])
def test_ivf_searches_whole_cells(cloud, blocks):
    points, cells, rows = cloud
    centroids = ann.cell_centroids(rows, "cell")
    found = ann.ann_search_ivf(
        rows.withColumnRenamed("id", "query_id"), rows, centroids, 5, 16, nprobe=2, cell="cell", **blocks
    )
    means = np.array([points[np.array(cells) == c].mean(axis=0) for c in range(4)])
    unit, mean_unit = points / np.linalg.norm(points, axis=1, keepdims=True), means / np.linalg.norm(means, axis=1, keepdims=True)
    probes = np.argsort(np.floor((1 - unit @ mean_unit.T) * 1e6 + 0.5), axis=1, kind="stable")[:, :2]
    allowed = [[cells[i] in probes[q] for i in range(150)] for q in range(150)]
    assert hits(found) == brute(points, 5, "cosine", allowed)


@pytest.mark.parametrize("blocks", [{}, SMALL])
def test_lsh_searches_shared_signatures(cloud, blocks):
    points, _cells, rows = cloud
    planes = ann.hyperplanes(16, tables=3, bits=3, seed=1)
    found = ann.ann_search_lsh(rows.withColumnRenamed("id", "query_id"), rows, 5, 16, planes, **blocks)
    signs = np.einsum("tbd,nd->ntb", planes, points) >= 0
    same = (signs[:, None] == signs[None]).all(axis=3).any(axis=2)
    assert hits(found) == brute(points, 5, "cosine", same)


def test_all_probes_give_full_recall(cloud):
    _points, _cells, rows = cloud
    queries = rows.withColumnRenamed("id", "query_id")
    approximate = ann.ann_search_ivf(queries, rows, ann.cell_centroids(rows, "cell"), 5, 16, nprobe=4, cell="cell")
    recall = ann.ann_recall(knn_join(queries, rows, 5, 16), approximate)
    assert {r["recall"] for r in recall.collect()} == {1.0}


def test_trained_cells(cloud):
    _points, _cells, rows = cloud
    centroids = ann.train_cells(rows, 3)
    assigned = ann.nearest_cells(rows, centroids, 16, 1)
    assert centroids.count() == 3 and assigned.where("size(cells) = 1").count() == 150


TEXTS = ["graph neural networks", "neural networks for graphs", "the the the", "été d'été", "", None, "networks"]


@pytest.mark.parametrize("blocks", [{}, {"broadcast_bytes": 0, "block_bytes": 4096 * 8 * 2, "block_items": 3}])
def test_text_search_ranks_by_shared_terms(spark, blocks):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")
    queries = spark.createDataFrame([(1, "Neural NETWORKS"), (2, " \n"), (3, "été")], "query_id bigint, text string")
    found = text_topk_search(queries, docs, 2, **blocks)
    assert hits(found) == {(1, 0, 1), (1, 1, 2), (3, 3, 1), (3, 0, 2)}


def test_embed_text_counts_terms(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")
    rows = embed_text(docs, "text").orderBy("id").collect()
    assert [sum(t["weight"] for t in r["terms"]) for r in rows] == [3, 4, 3, 3, 0, 0, 1]
    assert [len(r["terms"]) for r in rows] == [3, 4, 1, 2, 0, 0, 1]
    assert all([t["bucket"] for t in r["terms"]] == sorted(t["bucket"] for t in r["terms"]) for r in rows)


def test_model_lookup():
    register_model(EmbeddingModel("gated", 2, lambda: None, needs_key=True))
    with pytest.raises(ValueError, match="Unknown model: nope"):
        get_model("nope")
    with pytest.raises(ValueError, match="API key"):
        get_model("gated", " ")
    assert get_model("gated", "key").dim == 2


def test_filter_then_rank(cloud):
    points, _cells, rows = cloud
    query = [float(x) for x in points[3]]
    few = vector_search(rows, query, 150, where=F.col("cell") == 0)
    everything = vector_search(rows, query, 150).where("cell = 0")
    order = ["distance", "id"]
    assert few.select(*order).orderBy(*order).collect() == everything.select(*order).orderBy(*order).collect()


def test_search_records_both_join_forms(spark):
    papers = spark.createDataFrame(
        [(1, "T", "['a', 'b']", "l", " x \n", "b"), (2, None, None, None, None, None)],
        "id bigint, title string, keywords string, link string, abstract string, bibtex string",
    )
    found = spark.createDataFrame([(7, 1, 0.25, 1), (7, 2, 1.2, 2)], "query_id bigint, id bigint, distance double, rank int")
    for rows in (10, 0):
        got = [tuple(r) for r in search_records(found, papers, rows).orderBy("rank").collect()]
        assert got == [
            (7, 1, 1, "T", ["a", "b"], "l", "x", "b", 0.25, 0.75),
            (7, 2, 2, "Untitled", [""], "", "", "", 1.2, 1.2),
        ]


def test_dense_position_across_ranges(spark):
    positions = [0, 5, 9, 10, 11, 35, 1 << 40, (1 << 40) + 1]
    rows = spark.createDataFrame([(k, p) for k in "ab" for p in positions], "k string, p bigint")
    numbered = ranking.dense_position(rows, "p", "n", start=1, keys=["k"], width=10)
    assert sorted(map(tuple, numbered.collect())) == [(k, p, i + 1) for k in "ab" for i, p in enumerate(positions)]
    ids = ranking.assign_ids(rows.where("k = 'a'"), "p").orderBy("p").collect()
    assert [r["id"] for r in ids] == [str(i) for i in range(8)]


@pytest.mark.parametrize("page, ranks, shown", [(0, range(1, 11), 1), (3, [21], 3), (9, [21], 3), (2, range(11, 21), 2)])
def test_paging(spark, page, ranks, shown):
    results = spark.range(1, 22).select(F.lit("q").alias("query_id"), F.col("id").alias("rank"))
    got = ranking.paginate(results, page).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(ranks) and {(r["page"], r["total_pages"]) for r in got} == {(shown, 3)}


def test_pages_partition_the_result(spark):
    results = spark.range(1, 22).select(F.lit("q").alias("query_id"), F.col("id").alias("rank"))
    seen = [r["rank"] for page in (1, 2, 3) for r in ranking.paginate(results, page).collect()]
    assert sorted(seen) == list(range(1, 22))
    assert ranking.paginate(results.where("false"), 1).count() == 0


def test_dedup_keeps_first(spark):
    rows = spark.createDataFrame([("u", 3), ("u", 1), ("v", 2)], "url string, pos int")
    once = ranking.dedup_first_seen(rows, "url", "pos")
    assert sorted(map(tuple, once.collect())) == [("u", 1), ("v", 2)]
    assert sorted(map(tuple, ranking.dedup_first_seen(once, "url", "pos").collect())) == [("u", 1), ("v", 2)]


def test_first_nonempty_source_per_key(spark):
    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "venue string, year int, x string")

    sources = [rows(("A", 1, "s0")), rows(("A", 1, "s1"), ("B", 1, "s1"), (None, 2, "s1")), rows(("B", 1, "s2"), ("C", 1, "s2"))]
    got = joins.first_nonempty_source(sources).select("venue", "x").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("A", "s0"), ("B", "s1"), ("C", "s2"), (None, "s1")], key=repr)


def test_list_detail_join_keeps_failed_lookups(spark):
    entries = spark.createDataFrame([("u", "list u"), ("v", "list v"), ("w", "list w")], "detail_url string, title string")
    details = spark.createDataFrame([("u", "detail", ["a"]), ("v", "", None)], "detail_url string, title string, authors array<string>")
    got = {r["detail_url"]: (r["title"], r["authors"]) for r in joins.list_detail_join(entries, details).collect()}
    assert got == {"u": ("detail", ["a"]), "v": ("list v", []), "w": ("list w", [])}


def test_title_filters(spark):
    rows = spark.createDataFrame([("abcd",), ("abcde",), (None,), ("Nullabc",)], "title string")
    assert sorted(r[0] for r in clean.drop_short_titles(rows).collect()) == ["Nullabc", "abcde"]
    assert {r[0] for r in clean.drop_placeholder_titles(rows).collect()} == {"abcd", "abcde", None}


def test_accepted_only_acts_for_one_venue(spark):
    rows = spark.createDataFrame([("Submitted to X",), ("X Poster",), (None,), ("submission",)], "v string")
    assert {r[0] for r in clean.accepted_only(rows, "v", "ICLR", "Accepted").collect()} == {"X Poster", "submission"}
    assert clean.accepted_only(rows, "v", "ICML", "Accepted").count() == 4
    assert clean.accepted_only(rows, "v", "ICLR", "Submitted").count() == 4


def test_totals_add_up(spark):
    rows = spark.createDataFrame([("ACL", 2021, "main")] * 572 + [("ACL", 2021, "findings")] * 458, "venue string, year int, decision string")
    wide = stats.venue_year_stats(rows, ["main", "findings", "oral"]).collect()
    assert [tuple(r) for r in wide] == [("ACL", 2021, 572, 458, 0, 0)]
    total = stats.venue_year_totals(rows).where("level = 1").collect()
    assert [(r["venue"], r["year"], r["n"]) for r in total] == [("ACL", 2021, 1030)]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_unseen_both_join_forms(spark, limit):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "id string")
    stored = spark.createDataFrame([("b",), ("x",)], "id string")
    assert sorted(r["id"] for r in unseen(rows, stored, broadcast_bytes=limit).collect()) == ["a", "c"]


def test_knn_without_results_and_with_unusable_vectors(spark):
    corpus = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("nan", [float("nan"), 1.0]), ("inf", [float("inf"), 1.0]), ("zero", [0.0, 0.0])], "id string, embedding array<float>"
    )
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 0.0])], "query_id long, embedding array<float>")
    for blocks in ({}, {"broadcast_bytes": 0}):
        for space in ("cosine", "l2sq"):
            found = knn_join(queries, corpus, 9, 2, space, **blocks).collect()
            assert sorted((r["query_id"], r["id"]) for r in found) == [(1, "a"), (1, "zero")]
        assert knn_join(queries, corpus, 0, 2, **blocks).collect() == []
    assert knn_join(queries, corpus, 0, 2).columns == ["query_id", "id", "distance", "rank"]
