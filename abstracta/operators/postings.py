"""Inverted file over sparse vectors, and exact top-k that skips what cannot reach the kth score.

Documents are cut into shards of a bounded number of entries. A shard's vectors are stored by
bucket: a row has the bucket's documents in the shard, their weights and the largest share
``weight / length`` among them (``top``). Rows lie in folders by bucket, so a search reads the
folders of its queries' buckets only, and no vector is ever made dense.

A search bounds the score of every query in every shard by the sum of its weights times the
tops. The ``FIRST`` shards of highest bound give each query a kth score; shards whose bound lies
below it are skipped whole. Inside a shard the query's buckets are taken by falling bound: as
soon as the rest cannot bring a new document to the kth score, only documents that can still
reach it are looked up.

Cosine distance to ``digits`` digits, then id. Documents that share no bucket with a query are
never its neighbours; rows without an id, and queries or documents without entries, take no
part; of a repeated id the nearest row counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from abstracta.operators.knn import _arrow_schema, id_array, ordered, result_schema
from abstracta.session import checkpointed, scratch_path

PARTS = 64
SHARD_ROWS, SHARD_ENTRIES = 4096, 1 << 21
FIRST = 2
QUERY_BYTES = 16 * 1024 * 1024
#: The folder and bucket of a shard's ids and lengths.
HEAD = -1


def build_postings(docs: DataFrame, path: str, item_id: str = "id", vector: str = "terms", shard_rows: int = SHARD_ROWS) -> None:
    """Write the inverted file of ``docs`` (an id and ``array<struct<bucket, weight>>``) to ``path``."""
    kind = docs.schema[item_id].dataType
    rows = docs.where(F.col(item_id).isNotNull() & (F.size(vector) > 0)).select(F.col(item_id).alias("id"), F.col(vector).alias("terms"))
    out = T.StructType(
        [
            T.StructField("shard", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("top", T.DoubleType()),
            T.StructField("docs", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType())),
            T.StructField("ids", T.ArrayType(kind)),
        ]
    )
    ids_of = _arrow_schema(T.StructType([T.StructField("id", kind)])).field(0).type

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            ends = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = min(start + shard_rows, max(start + 1, int(np.searchsorted(ends, before + SHARD_ENTRIES, "right"))))
                yield shard_rows_of(shard, batch.slice(start, stop - start), ids_of)
                shard, start = shard + 1, stop

    # One head without documents, so that a file tells the schema of an empty collection.
    no_shard = docs.sparkSession.createDataFrame([(-1, HEAD, 0.0, [], [], [])], out)
    listed = rows.mapInArrow(task, out).unionByName(no_shard)
    part = F.when(F.col("bucket") == HEAD, F.lit(HEAD)).otherwise(F.pmod("bucket", F.lit(PARTS)).cast("int"))
    # By folder and a few shards of it, so that a folder is written by several tasks; nothing is sampled first.
    dealt = listed.withColumn("part", part).repartition("part", F.pmod("shard", F.lit(16))).sortWithinPartitions("part", "bucket", "shard")
    dealt.write.mode("overwrite").partitionBy("part").parquet(path)


def shard_rows_of(shard: int, batch: pa.RecordBatch, ids_of: pa.DataType) -> pa.RecordBatch:
    """The postings of one shard, and its head row with ids and lengths."""
    lists = batch.column(1)
    entries = lists.flatten()
    bucket = entries.field("bucket").to_numpy(zero_copy_only=False)
    weight = entries.field("weight").to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    length = np.sqrt(np.bincount(doc, np.square(weight), len(lists)))
    order = np.lexsort((doc, bucket))
    bucket, weight, doc = bucket[order], weight[order], doc[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    share = np.divide(weight, length[doc], out=np.zeros_like(weight), where=length[doc] > 0)
    top = np.maximum.reduceat(share, starts)
    n = len(starts)
    offsets = pa.array(np.r_[0, starts, len(bucket)], pa.int32())
    # The head comes first and has no documents; its lengths stand where weights do.
    held = np.r_[length, weight]
    weights = pa.ListArray.from_arrays(pa.array(np.r_[0, len(length) + starts, len(held)], pa.int32()), pa.array(held))
    ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(n + 1, len(lists))], pa.int32()), batch.column(0).cast(ids_of))
    columns = [
        pa.array(np.full(n + 1, shard)), pa.array(np.r_[HEAD, bucket[starts]], pa.int32()), pa.array(np.r_[0.0, top]),
        pa.ListArray.from_arrays(offsets, pa.array(doc)), weights, ids,
    ]
    return pa.RecordBatch.from_arrays(columns, ["shard", "bucket", "top", "docs", "weights", "ids"])


Query = tuple[np.ndarray, np.ndarray, float]


def best_in_shard(
    query: Query, postings: dict[int, tuple[np.ndarray, np.ndarray, float]], lengths: np.ndarray, ids: np.ndarray, k: int,
    least: float, digits: int = 6,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and distances of a query's ``k`` best documents in a shard, and the products made.

    ``least`` is a score that a document must reach; documents that round to the same distance
    as it are kept.
    """
    margin = 2.0 * 10.0**-digits
    terms = [(w * postings[b][2] / query[2], b, w) for b, w in zip(query[0].tolist(), query[1].tolist()) if b in postings]
    terms.sort(key=lambda t: (-t[0], t[1]))
    rest = np.r_[np.cumsum([t[0] for t in terms][::-1])[::-1], 0.0]
    dots, products, few = np.zeros(len(lengths)), 0, None
    scale = np.where(lengths > 0, query[2] * lengths, np.inf)
    for i, (_, bucket, weight) in enumerate(terms):
        if i and len(dots) > k:
            seen = dots / scale if few is None else dots[few] / scale[few]
            if len(seen) > k:
                least = max(least, float(np.partition(seen, -k)[-k]))
        if few is None and rest[i] < least - margin:
            few = np.flatnonzero(dots)
        if few is not None:
            few = few[dots[few] / scale[few] + rest[i] >= least - margin]
        docs, weights, _ = postings[bucket]
        if few is None:
            dots[docs] += weight * weights
            products += len(docs)
        else:
            at = np.minimum(np.searchsorted(docs, few), len(docs) - 1)
            met = docs[at] == few
            dots[few[met]] += weight * weights[at[met]]
            products += int(met.sum())
    found = np.flatnonzero(dots) if few is None else few[dots[few] > 0]
    distance = 1.0 - dots[found] / scale[found]
    good = distance <= 1.0 - least + margin
    found, distance = found[good], distance[good]
    order = np.lexsort((ids[found], np.floor(distance * 10.0**digits + 0.5)))
    _, first = np.unique(ids[found][order], return_index=True)  # the nearest row of an id
    order = order[np.sort(first)[:k]]
    return found[order], distance[order], products


def _blocks(queries: DataFrame, query_bytes: int) -> Iterator[pa.Table]:
    """The queries in pieces of bounded size."""
    size = queries.agg(F.sum(F.size("terms") * 16 + 32)).head()[0] or 0
    blocks = -(-size // query_bytes)
    for number in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id", "terms"), F.lit(blocks)) == number)
        table = part.toArrow()
        if table.num_rows:
            yield table.combine_chunks()


def postings_topk(
    spark: SparkSession, path: str, queries: DataFrame, k: int, *, query_id: str = "query_id", vector: str = "terms",
    digits: int = 6, first: int = FIRST, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """``query_id, id, distance, rank`` of the ``k`` nearest documents in an inverted file.

    Queries go over it in blocks of bounded size; of a repeated query id all rows are asked.
    """
    asked = queries.where(F.size(vector) > 0).select(F.col(query_id).alias("query_id"), F.col(vector).alias("terms"))
    listed = spark.read.parquet(path)
    kinds = spark.createDataFrame([], T.StructType([T.StructField("id", listed.schema["ids"].dataType.elementType)]))
    schema = result_schema(asked, "query_id", kinds, "id")
    hits = spark.createDataFrame([], schema)
    for table in _blocks(asked, query_bytes) if int(k) > 0 else ():
        hits = hits.unionByName(_search(spark, listed, table, int(k), schema, digits, first))
    once = hits.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return ordered(once, max(1, int(k)), digits)


def _search(spark: SparkSession, listed: DataFrame, table: pa.Table, k: int, schema: T.StructType, digits: int, first: int) -> DataFrame:
    terms = table.column("terms").combine_chunks()
    counts = np.diff(terms.offsets.to_numpy())
    bucket = terms.flatten().field("bucket").to_numpy(zero_copy_only=False)
    weight = terms.flatten().field("weight").to_numpy(zero_copy_only=False)
    asking = np.repeat(np.arange(len(counts)), counts)
    length = np.sqrt(np.bincount(asking, np.square(weight), len(counts)))
    cuts = np.cumsum(counts)[:-1]
    known = list(zip(np.split(bucket, cuts), np.split(weight, cuts), length.tolist()))
    shared = spark.sparkContext.broadcast((table.column("query_id").combine_chunks(), known))  # a block of bounded size

    wanted = np.unique(bucket).tolist()
    folders = sorted({b % PARTS for b in wanted})
    rows = listed.where(F.col("part").isin(folders) & F.col("bucket").isin(wanted))
    spread = pa.table({"q": asking, "bucket": bucket, "share": weight / length[asking]})
    # The block's own entries; their size is that of the broadcast above.
    shares = F.broadcast(spark.createDataFrame(spread).select(F.col("q").cast("int").alias("q"), F.col("bucket").cast("int").alias("bucket"), "share"))
    bounds = rows.select("shard", "bucket", "top").join(shares, "bucket").groupBy("q", "shard").agg(F.sum(F.col("share") * F.col("top")).alias("bound"))
    bounds = checkpointed(bounds)
    order = Window.partitionBy("q").orderBy(F.col("bound").desc(), "shard")
    placed = bounds.withColumn("place", F.row_number().over(order))
    lead = placed.where(F.col("place") <= first).select("q", "shard", F.lit(0.0).alias("least"))
    found = checkpointed(_scored(lead, listed, rows, shared, k, schema, digits))
    # The kth score of the first shards, where they hold k documents.
    reached = Window.partitionBy("q").orderBy("distance", "id")
    kth = found.withColumn("place", F.row_number().over(reached)).where(F.col("place") == k).select("q", (1 - F.col("distance")).alias("least"))
    margin = 3.0 * 10.0**-digits  # rounding, and sums in another order
    done = lead.select("q", "shard")
    open_pairs = bounds.join(done, ["q", "shard"], "left_anti").join(F.broadcast(kth), "q", "left")  # a row for each query of the block
    more = open_pairs.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - margin))
    more = more.select("q", "shard", F.coalesce("least", F.lit(0.0)).alias("least"))
    rest = _scored(more, listed, rows, shared, k, schema, digits)
    return found.select(*schema.names).unionByName(rest.select(*schema.names))


def _scored(pairs: DataFrame, listed: DataFrame, rows: DataFrame, shared, k: int, schema: T.StructType, digits: int) -> DataFrame:
    """Score pairs of query and shard: a shard's postings of the wanted buckets meet its pairs."""
    heads = listed.where(F.col("part") == HEAD)
    needed = heads.unionByName(rows).join(pairs.select("shard").distinct(), "shard", "left_semi")
    out = T.StructType([T.StructField("q", T.IntegerType()), *schema])
    arrow = _arrow_schema(out)

    def score(pairs: pa.Table, postings: pa.Table) -> pa.Table:
        if not pairs.num_rows or not postings.num_rows:
            return arrow.empty_table()
        names, known = shared.value
        head, held = None, {}
        buckets, tops = postings.column("bucket").to_pylist(), postings.column("top").to_pylist()
        for i, bucket in enumerate(buckets):
            if bucket == HEAD:
                head = i
            else:
                docs, weights = postings.column("docs")[i].values, postings.column("weights")[i].values
                held[bucket] = docs.to_numpy(), weights.to_numpy(), tops[i]
        lengths = postings.column("weights")[head].values.to_numpy()
        ids = id_array(postings.column("ids")[head].values)
        parts = []
        for q, least in zip(pairs.column("q").to_pylist(), pairs.column("least").to_pylist()):
            at, distance, _ = best_in_shard(known[q], held, lengths, ids, k, least, digits)
            parts.append((np.full(len(at), q, np.int32), ids[at], distance))
        q, found, distance = (np.concatenate(p) for p in zip(*parts))
        columns = [pa.array(q), names.take(pa.array(q)), pa.array(found.tolist(), arrow.field(2).type), pa.array(distance)]
        return pa.table([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return pairs.groupBy("shard").cogroup(needed.drop("part").groupBy("shard")).applyInArrow(score, out)


def postings_search(queries: DataFrame, docs: DataFrame, k: int, *, path: str | None = None, **options) -> DataFrame:
    """Top-k of sparse queries in sparse documents through an inverted file in the shared folder."""
    path = path or scratch_path(docs.sparkSession, "postings")
    build_postings(docs, path)
    return postings_topk(docs.sparkSession, path, queries, k, **options)
