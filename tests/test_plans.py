"""The physical plans are the ones the design relies on."""

import pytest
from pyspark.sql import functions as F

from abstracta.catalog import QUERIES
from abstracta.operators.clean import venue_year_filter
from abstracta.operators.embed import embed_text, explode_terms
from abstracta.operators.knn import knn_join
from abstracta.operators.ranking import dedup_first_seen, paginate, topk_per_group
from abstracta.plans.results import read_page, store_results
from abstracta.plans.search import vector_search
from abstracta.session import spread, table
from abstracta.sources.snapshot import write_snapshot

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_single_query_is_a_bounded_sort(spark):
    hits = vector_search(table(spark, SF, "embeddings").withColumnRenamed("vec_id", "id"), [0.1] * 64, 5)
    assert "TakeOrderedAndProject" in plan(hits)
    assert "label" not in plan(hits.select("id", "distance")).split("ReadSchema")[1]


def test_group_limits_come_before_the_exchange(spark):
    docs = table(spark, SF, "documents").select("doc_id", "lang", "n_chars")
    for frame in (topk_per_group(docs, ["lang"], ["n_chars", "doc_id"], 3), dedup_first_seen(docs, "lang", "doc_id")):
        text = plan(frame)
        assert text.count("WindowGroupLimit") == 2
        assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_knn_does_not_shuffle_the_corpus(spark):
    e = table(spark, SF, "embeddings")
    for queries, exchanges in ((e, 1), (e.where("vec_id < 3"), 2)):
        hits = knn_join(queries.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "id"), 3, 64)
        text = plan(hits)
        # Candidates are exchanged once per query, those of few queries in parts before; above the scan.
        assert text.count("Exchange") == exchanges and text.rindex("Exchange") < text.index("MapInArrow")
        assert "Join" not in text and "CartesianProduct" not in text


def test_stored_pages_are_read_without_searching(spark, tmp_path):
    e = table(spark, SF, "embeddings")
    hits = knn_join(e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "id"), 25, 64)
    path = str(tmp_path / "hits")
    store_results(hits, path)
    page = read_page(spark, path, 2)
    text = plan(page)
    assert "Arrow" not in text and "Python" not in text and "Exchange" not in text and "LessThanOrEqual(rank,20)" in text
    want = paginate(hits, 2).select("query_id", "id", "rank", "page", "total_pages")
    assert sorted(map(tuple, page.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    one = read_page(spark, path, 99, query=7)
    assert "part" in plan(one).split("PartitionFilters: ")[1].split("]")[0]
    assert [(r["rank"], r["page"], r["total_pages"]) for r in one.orderBy("rank").collect()] == [(i, 3, 3) for i in range(21, 26)]
    assert read_page(spark, path, -5, query=7).count() == 10 and read_page(spark, path, 1, query=10**9).count() == 0
    # Lists without a query, shorter than a page, or of no rows.
    lists = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (3, 1, "c")], "query_id long, rank int, id string")
    store_results(lists, str(tmp_path / "l"))
    assert read_page(spark, str(tmp_path / "l"), 4).count() == 3
    store_results(lists.limit(0), str(tmp_path / "n"))
    assert read_page(spark, str(tmp_path / "n"), 1).count() == 0


def test_embedding_does_not_shuffle_and_runs_once(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    text = plan(explode_terms(embed_text(docs, "text"), "doc_id"))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 1


def test_venue_and_year_prune_partitions(spark, tmp_path):
    rows = spark.range(20).select(
        "id", F.concat(F.lit("v"), F.col("id") % 4).alias("venue"), (F.lit(2020) + F.col("id") % 3).cast("int").alias("year"),
        F.to_timestamp(F.lit("2026-01-01 00:00:00")).alias("snapshot_ts"),
    )
    write_snapshot(rows, str(tmp_path / "t"))
    text = plan(venue_year_filter(spark.read.parquet(str(tmp_path / "t")), ["v1", "v2"], [2021]))
    filters = text.split("PartitionFilters: ")[1].split("]")[0]
    assert "venue" in filters and "year" in filters


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["language_filter"](spark, SF))
    assert "PushedFilters: [In(lang, [es,fr])]" in text or "PushedFilters: [In(lang, [fr,es])]" in text
    assert "n_chars" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize("key", ["text_topk_search", "knn_join", "list_detail_join", "first_nonempty_source", "assign_ids"])
def test_no_cross_join(spark, key):
    text = plan(QUERIES[key](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_spread_only_adds_missing_partitions(spark):
    small = table(spark, SF, "labels")
    wide = spark.range(0, 100, 1, 16)
    assert spread(small).rdd.getNumPartitions() == 8 and spread(wide) is wide


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0 and set(oracle_sql()) <= set(queries())
