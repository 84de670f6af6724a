"""The inverted file: equal to the dense search, with fewer products and folders."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from abstracta.operators import postings
from abstracta.operators.embed import embed_text
from abstracta.operators.knn import knn_join
from abstracta.session import table

SF = "/root/testdata/sf0.01"
DIM = 4096


def sides(spark, sf=SF):
    queries = embed_text(table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"), "text")
    return queries, embed_text(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "text")


def hits(frame):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 6)) for r in frame.collect())


@pytest.mark.parametrize("first, query_bytes", [(2, postings.QUERY_BYTES), (1, 4096)])
def test_equals_the_dense_search(spark, tmp_path, first, query_bytes):
    queries, docs = sides(spark)
    path = str(tmp_path / "p")
    postings.build_postings(docs, path, shard_rows=100)
    got = postings.postings_topk(spark, path, queries, 10, first=first, query_bytes=query_bytes)
    assert hits(got) == hits(knn_join(queries, docs, 10, DIM, query_vector="terms", item_vector="terms"))


def random_shard(rng, n, dim, per_doc):
    lists = []
    for _ in range(n):
        buckets = np.sort(rng.choice(dim, per_doc, replace=False, p=weights_of(dim)))
        lists.append([{"bucket": int(b), "weight": float(rng.integers(1, 5))} for b in buckets])
    kind = pa.list_(pa.struct([("bucket", pa.int32()), ("weight", pa.float64())]))
    batch = pa.record_batch([pa.array(range(n), pa.int64()), pa.array(lists, kind)], names=["id", "terms"])
    rows = postings.shard_rows_of(3, batch, pa.int64()).to_pylist()
    head = rows[0]
    held = {r["bucket"]: (np.array(r["docs"]), np.array(r["weights"]), r["top"]) for r in rows[1:]}
    return lists, held, np.array(head["weights"]), np.array(head["ids"])


def weights_of(dim):
    share = 1 / np.arange(1, dim + 1)
    return share / share.sum()


@pytest.mark.parametrize("least", [0.0, 0.3])
def test_fewer_products_and_the_same_best(least):
    rng = np.random.default_rng(9)
    lists, held, lengths, ids = random_shard(rng, 800, 500, 30)
    made = full = 0
    for q in range(0, 800, 40):
        # Rare buckets weigh more in the query, as the words that matter do.
        bucket = np.array([e["bucket"] for e in lists[q]])
        weight = np.round(1 + 10 * bucket / 500)
        query = bucket, weight, float(np.sqrt(np.square(weight).sum()))
        at, distance, products = postings.best_in_shard(query, held, lengths, ids, 10, least)
        dots = np.zeros(800)
        for b, w in zip(bucket, weight):
            docs, weights, _ = held[b]
            dots[docs] += w * weights
            full += len(docs)
        exact = 1 - dots / (query[2] * lengths)
        order = np.lexsort((ids, np.floor(exact * 1e6 + 0.5)))[:10]
        order = order[(exact[order] <= 1 - least + 1e-9) & (dots[order] > 0)]
        assert at.tolist()[: len(order)] == order.tolist() and np.allclose(distance[: len(order)], exact[order])
        made += products
    print(f"products {made} of {full}")
    assert made < 0.7 * full


def test_plan_reads_the_folders_of_the_queries(spark, tmp_path):
    queries, docs = sides(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "p")
    postings.build_postings(docs, path)
    one = queries.limit(1).withColumn("terms", F.slice("terms", 1, 2))
    text = postings.postings_topk(spark, path, one, 3)._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in text.split("PartitionFilters: [")[1:]]
    assert filters and all("part" in f for f in filters)
    assert "In(bucket" in text and "CartesianProduct" not in text


def test_awkward_rows(spark, tmp_path):
    kind = "array<struct<bucket:int,weight:double>>"
    docs = spark.createDataFrame(
        [("b", [(1, 1.0), (2, 1.0)]), ("a", [(1, 1.0), (2, 1.0)]), ("a", [(1, 5.0)]), ("a", [(1, 1.0), (2, 1.0)]), (None, [(1, 1.0)]),
         ("empty", []), ("null", None), ("far", [(9, 1.0)]), ("zero", [(1, 0.0)])],
        f"id string, terms {kind}",
    )
    docs = docs.withColumns({c: F.lit("x") for c in ("bucket", "shard", "part", "q", "query_id")})
    queries = spark.createDataFrame([(1, [(1, 1.0), (2, 1.0)]), (2, []), (3, None), (4, [(77, 1.0)]), (None, [(9, 2.0)]), (1, [(1, 1.0), (2, 1.0)])], f"query_id long, terms {kind}")
    path = str(tmp_path / "p")
    postings.build_postings(docs, path, shard_rows=2)
    found = [(r["query_id"], r["rank"], r["id"]) for r in postings.postings_topk(spark, path, queries, 2).collect()]
    assert sorted(found, key=str) == [(1, 1, "a"), (1, 2, "b"), (None, 1, "far")]
    assert postings.postings_topk(spark, path, queries, 0).collect() == []
    assert postings.postings_topk(spark, path, queries.limit(0), 2).collect() == []
    postings.build_postings(docs.limit(0), path)
    assert postings.postings_topk(spark, path, queries, 2).collect() == []


def test_a_hot_bucket_and_copies(spark, tmp_path):
    """A third of the rows are one text: ties go to the smaller id, shard by shard."""
    docs = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("same words here")).otherwise(F.concat(F.lit("words number "), "id")).alias("text")
    )
    docs = embed_text(docs, "text")
    queries = embed_text(spark.createDataFrame([(1, "same words here")], "query_id long, text string"), "text")
    path = str(tmp_path / "p")
    postings.build_postings(docs, path, shard_rows=64)
    got = postings.postings_topk(spark, path, queries, 5).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 3, 6, 9, 12]
