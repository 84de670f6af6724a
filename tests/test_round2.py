"""Inputs that once lost rows or text, or ended the job."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from abstracta.functions import html, text, vectors
from abstracta.functions.records import unwrap_value
from abstracta.operators import ann, joins, ranking, stats
from abstracta.operators.embed import EmbeddingModel, hashed_dense_model, register_model
from abstracta.operators.knn import knn_join
from abstracta.plans import harvest, index, search
from abstracta.sources import pages, snapshot, textfiles


def test_text_that_only_begins_like_json_stays(values):
    raw = ['"Why Should I Trust You?": Explaining', "{alpha}-divergence", '{"value": "a"} b', '"a", "b"', '{"value": 1}', '"q"', "null", '{"a": 1}']
    assert values(raw, unwrap_value) == [*raw[:4], "1", "q", None, '{"a": 1}']


@pytest.mark.parametrize("splittable", [True, False])
def test_dashes_at_the_start_of_a_file_stay(spark, tmp_path, splittable):
    (tmp_path / "e.txt").write_text("--flag: Title: A-------Title: B-----")
    rows = textfiles.read_export_blocks(spark, str(tmp_path), splittable).orderBy("pos").collect()
    assert [r["value"] for r in rows] == ["--flag: Title: A", "Title: B"]


def test_null_keys_are_keys(spark):
    rows = spark.createDataFrame([(None, 5), ("a", 1), (None, 9_000_000)], "source string, p long")
    numbered = ranking.dense_position(rows, "p", keys=["source"]).collect()
    assert sorted((r["p"], r["pos"]) for r in numbered) == [(1, 0), (5, 0), (9_000_000, 1)]
    ranked = spark.createDataFrame([(None, 1), (1, 1)], "query_id long, rank int")
    assert ranking.paginate(ranked, 1).count() == 2
    stamps = spark.createDataFrame([(None, 1, "2025-01-01"), ("v", 1, "2025-01-01")], "venue string, year int, t string")
    assert snapshot.latest_snapshot(stamps.withColumn("snapshot_ts", F.to_timestamp("t"))).count() == 2


def test_top_k_beyond_the_group_limit(spark):
    rows = spark.range(0, 3000, 1, 7).select((F.col("id") % 2).alias("key"), "id")
    top = ranking.topk_per_group(rows, ["key"], ["id"], 1100).collect()
    assert len(top) == 2200 and all(r["rank"] == r["id"] // 2 + 1 for r in top)


def test_vectors_without_length(spark):
    rows = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    got = rows.select(vectors.distance_cosine(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["d"] for r in got] == [1.0, 0.0, None]


@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_and_missing_ids_in_knn(spark, parts):
    corpus = spark.createDataFrame([("x", [1.0, 0.0]), ("x", [0.9, 0.1]), ("y", [0.0, 1.0]), (None, [1.0, 0.0])], "id string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    hits = knn_join(queries, corpus.repartition(parts), 5, 2).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in hits] == [("x", 1), ("y", 2)]


def test_classes_not_listed_are_counted(spark):
    rows = spark.createDataFrame([("v", 1, "oral"), ("v", 1, "desk"), ("v", 1, None)], "venue string, year int, decision string")
    assert [tuple(r) for r in stats.venue_year_stats(rows, ["oral"]).collect()] == [("v", 1, 1, 2)]


def test_repeated_details_do_not_multiply(spark):
    entries = spark.createDataFrame([("u", "list")], "detail_url string, title string")
    details = spark.createDataFrame([("u", "old", 1), ("u", "new", 2)], "detail_url string, title string, n int")
    assert [r["title"] for r in joins.list_detail_join(entries, details, order="n").collect()] == ["new"]


def test_missing_values_in_records(spark, values):
    assert values([None, "[1, 'a']"], text.parse_keywords) == [None, ["1", "a"]]
    shown = lambda score: text.safe_filename(F.lit(1), score, F.lit("v"), F.lit("t"))
    assert values([-0.5, None, 0.815], shown, "double") == ["01 - -0.50 - v - t.pdf", None, "01 - 0.81 - v - t.pdf"]
    notes = spark.createDataFrame([({"title": "t"},)], "content map<string,string>")
    row = harvest.notes_to_papers(notes, F.lit("v"), F.lit("2024b"), F.lit("s")).first()
    assert row["authors"] == [] and row["year"] is None and row["keywords"] is None


def test_search_a_stored_collection(spark, tmp_path):
    root = str(tmp_path / "store")
    index.create_store(spark, root)
    rows = [(str(i), f"word{i} word{i} other", {"lang": "en" if i % 2 else "de", "title": f"T{i}"}) for i in range(8)]
    docs = spark.createDataFrame(rows, "id string, document string, metadata map<string,string>")
    model = register_model(hashed_dense_model(1024))
    index.index_append(docs, root, "terms")
    index.index_append(docs, root, model.name, index.model_embedder(model.name))
    queries = spark.createDataFrame([(1, "word3"), (2, "word4")], "query_id long, text string")
    for name, dense in (("terms", False), (model.name, True)):
        hits = search.search_collection(spark, root, name, queries, 1, dense=dense)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema" in plan and "document:string" not in plan
        assert {r["query_id"]: r["id"] for r in hits.collect()} == {1: "3", 2: "4"}
        english = search.search_collection(spark, root, name, queries, 8, dense=dense, where=F.col("metadata")["lang"] == "en")
        assert {r["id"] for r in english.collect()} == {"1", "3", "5", "7"}
    papers = search.collection_papers(index.open_collection(spark, root, "terms"))
    hits = search.search_collection(spark, root, "terms", queries, 1)
    assert sorted(r["title"] for r in search.search_records(hits, papers).collect()) == ["T3", "T4"]
    gated = register_model(EmbeddingModel("gated", 1024, model.load, needs_key=True))
    with pytest.raises(ValueError):
        index.model_embedder(gated.name)


def test_numbers_of_positions_far_apart(spark):
    places = [-(2**62), -7, 0, 3, 10**6, 10**12, 2**62]
    rows = spark.createDataFrame([(k, p) for k in ("a", None) for p in places], "key string, p long")
    numbered = ranking.dense_position(rows, "p", keys=["key"], width=10).collect()
    assert len(numbered) == 14 and all(places[r["pos"]] == r["p"] for r in numbered)


def test_knn_bounds_queries_times_k_and_merges_in_parts(spark):
    corpus = spark.range(0, 300, 1, 6).selectExpr("id", "array(cast(id % 7 as float), cast(id % 11 as float)) AS embedding")
    queries = corpus.where("id < 9").withColumnRenamed("id", "query_id")
    scanned = knn_join(queries, corpus, 20, 2, "l2sq").orderBy("query_id", "rank").collect()
    blocked = knn_join(queries, corpus, 20, 2, "l2sq", held=40).orderBy("query_id", "rank").collect()
    assert scanned == blocked and len(scanned) == 180


def test_cells_from_blocks_of_centroids(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, embedding array<float>")
    centroids = rows.selectExpr("id AS cell", "cast(embedding as array<double>) AS centroid")
    whole = ann.nearest_cells(rows, centroids, 2, 3, space="l2sq").orderBy("id").collect()
    assert ann.nearest_cells(rows, centroids, 2, 3, space="l2sq", block_bytes=64).orderBy("id").collect() == whole
    assert whole[5]["cells"] == [5, 4, 6]


@pytest.mark.parametrize("listed", [10_000, 5])
def test_search_drops_cells_not_probed(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(ann, "LISTED_CELLS", listed)
    made = spark.range(60).selectExpr("id", "id % 30 AS cell", "array(cast(id % 30 as float), 1f) AS embedding")
    made.coalesce(1).write.partitionBy("cell").parquet(str(tmp_path / "cells"))
    corpus = spark.read.parquet(str(tmp_path / "cells"))
    centroids = made.where("id < 30").selectExpr("cell", "cast(embedding as array<double>) AS centroid")
    queries = made.where("id < 20").selectExpr("id AS query_id", "embedding")
    hits = ann.ann_search_ivf(queries, corpus, centroids, 2, 2, 1, cell="cell", space="l2sq")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert ("cell#" in plan and " IN (" in plan or " INSET " in plan) if listed > 5 else "LeftSemi" in plan
    assert {(r["query_id"], r["id"]) for r in hits.collect()} == {(i, j) for i in range(20) for j in (i, i + 30)}


def test_nodes_that_hold_their_own_tag(values):
    page = '<div id="abstract"><div>Part one</div> part two</div><div id="abstract">b</div>'
    assert values([page, None, "<p>"], lambda x: html.element(x, "div", html.has_id("abstract"))) == ["<div>Part one</div> part two", None, None]
    assert values([page], lambda x: html.elements(x, "div|p", html.has_id("abstract"))[0]) == ["<div>Part one</div> part two"]
    listed = '<div class="ptitle"><div>x</div><a href="u">t</a></div>'
    assert values([listed], lambda x: pages.titled_links(x)[0]["href"]) == ["u"]
