"""Result lists of a search, stored once and read page by page.

``<path>/part=<hash of the query>/*.parquet``, with the length of its list beside each row, so a
page needs neither the search nor a count again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

PARTS = 64


def _part(query: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(query), F.lit(parts)).cast("int")


def store_results(results: DataFrame, path: str, query_id: str = "query_id", rank: str = "rank", parts: int = PARTS) -> None:
    """Write ranked lists into ``parts`` folders by a hash of their query.

    The lists come out of a window over the query, so their length is one more window on rows
    that lie together. Rows of a folder lie in order of query and rank.
    """
    length = F.max(rank).over(Window.partitionBy(query_id))
    rows = results.withColumn("_length", length.cast("long")).withColumn("part", _part(F.col(query_id), parts))
    # Folders are dealt to tasks by the query's own hash; the hint cuts a folder that is too large.
    rows = rows.hint("rebalance", "part").sortWithinPartitions("part", query_id, rank)
    fields = {"schema": results.schema.jsonValue(), "query_id": query_id, "rank": rank, "parts": parts}
    rows.write.mode("overwrite").partitionBy("part").parquet(path)
    results.sparkSession.createDataFrame([(json.dumps(fields),)], "fields string").coalesce(1).write.mode("overwrite").text(f"{path}/_fields")


def read_page(spark: SparkSession, path: str, page: int, per_page: int = 10, query: object = None) -> DataFrame:
    """One page of every stored list, or of one query's: its rows, ``page`` and ``total_pages``.

    ``page`` is clamped to ``[1, total_pages]``. Rows behind the wanted page are not read.
    """
    fields = json.loads(spark.read.text(f"{path}/_fields").head()[0])
    schema = T.StructType.fromJson(fields["schema"])
    stored = spark.read.schema(T.StructType([*schema, T.StructField("_length", T.LongType()), T.StructField("part", T.IntegerType())]))
    rank, page = F.col(fields["rank"]), max(1, int(page))
    rows = stored.parquet(path).where(rank <= page * per_page)
    if query is not None:
        asked = F.lit(query).cast(schema[fields["query_id"]].dataType)
        rows = rows.where((F.col("part") == _part(asked, fields["parts"])) & (F.col(fields["query_id"]) == asked))
    pages = (F.floor((F.col("_length") - 1) / F.lit(per_page)) + 1).cast("int")
    rows = rows.withColumn("total_pages", pages).withColumn("page", F.least(F.lit(page), F.col("total_pages")))
    return rows.where((rank > (F.col("page") - 1) * per_page) & (rank <= F.col("page") * per_page)).drop("_length", "part")
