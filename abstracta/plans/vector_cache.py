"""Vectors by content: a text that a model has embedded once is not embedded again.

``<root>/_vectors/model=<name>/load=<id>/*.parquet`` keeps ``digest, embedding``. An append, a
rebuild or a resumed load embeds only the distinct texts that the table lacks, and takes all
vectors from it.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from abstracta.operators.embed import embedding_function, get_model
from abstracta.plans.index import BROADCAST_BYTES, Embedder, _folder

_SCHEMA = "digest string, embedding array<float>"


def known_vectors(spark: SparkSession, root: str, model: str) -> DataFrame:
    """``digest, embedding``, once for each text, however often it was written."""
    try:
        found = spark.read.schema(_SCHEMA).parquet(_folder(f"{root}/_vectors", model))
    except AnalysisException:  # nothing was ever embedded
        return spark.createDataFrame([], _SCHEMA)
    return found.select("digest", "embedding").dropDuplicates(["digest"])


def cached_embedder(root: str, name: str, api_key: str = "", broadcast_bytes: int = BROADCAST_BYTES) -> Embedder:
    """Embedder of a registered dense model that keeps its vectors beside the store ``root``.

    A null text is the empty one. Texts meet their vectors by digest: the vectors of a load
    are broadcast if they are counted to fit, else joined, where adaptive execution splits the
    rows of a text that fills a task.
    """
    model = get_model(name, api_key)
    column = embedding_function(model)

    def embed(rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        text = F.coalesce("document", F.lit(""))
        marked = rows.withColumn("_digest", F.sha2(text.cast("binary"), 256))
        # The digests go first; a document is carried only where its text is new.
        known = known_vectors(spark, root, name).select(F.col("digest").alias("_digest"))
        missing = marked.select("_digest", text.alias("_text")).join(known, "_digest", "left_anti").dropDuplicates(["_digest"])
        fresh = missing.select(F.col("_digest").alias("digest"), column("_text").alias("embedding"))
        fresh.write.mode("append").parquet(f"{_folder(f'{root}/_vectors', name)}/load={uuid.uuid4().hex}")
        wanted = marked.select("_digest").distinct()
        vectors = known_vectors(spark, root, name).withColumnsRenamed({"digest": "_digest", "embedding": "_vector"})
        vectors = vectors.join(wanted, "_digest", "left_semi")
        small = wanted.count() * (model.dim * 4 + 96) <= broadcast_bytes
        found = marked.join(F.broadcast(vectors) if small else vectors, "_digest")
        return found.withColumn("embedding", F.col("_vector")).drop("_digest", "_vector")

    return embed
