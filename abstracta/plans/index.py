"""Vector tables: a folder for each model, in it one for each cell, in it one for each load.

``<root>/model=<name>/cell=<number>/batch=<load>/*.parquet``. A load that runs again overwrites
its own folders only, which makes appends and stream batches repeatable.

A collection with trained cells is an inverted file: its centroids are tables beside the
vectors (``<root>/_cells``), every load puts each vector into the folder of its cell, and a
search reads the folders of the cells that it probes. Without cells all is in cell -1.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from abstracta.operators.cell_tree import GROUPS, CellTree, assigned
from abstracta.operators.embed import embed_text, embedding_function, get_model
from abstracta.operators.ranking import dedup_first_seen
from abstracta.schema import VECTORS

BROADCAST_BYTES = 64 * 1024 * 1024
NO_CELL = -1
Embedder = Callable[[DataFrame], DataFrame]


def hashed_terms(rows: DataFrame) -> DataFrame:
    """Default embedder: sparse term counts of the document."""
    return embed_text(rows, "document", name="terms")


def model_embedder(name: str, api_key: str = "") -> Embedder:
    """Embedder of a registered dense model; the key check is that of ``get_model``."""
    column = embedding_function(get_model(name, api_key))
    return lambda rows: rows.withColumn("embedding", column(F.coalesce("document", F.lit(""))))


def _folder(root: str, model: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.\-]+", model):
        raise ValueError(f"Model name {model!r} cannot name a folder")
    return f"{root}/model={model}"


def create_store(spark: SparkSession, root: str) -> None:
    """An empty store, unless there is one."""
    spark.createDataFrame([], VECTORS).write.mode("ignore").partitionBy("model", "cell", "batch").parquet(root)


def read_store(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(root)


def list_collections(spark: SparkSession, root: str) -> DataFrame:
    """Models and their sizes, without superseded rows."""
    return without_superseded(read_store(spark, root), root).groupBy("model").agg(F.count("*").alias("n"))


def open_collection(spark: SparkSession, root: str, model: str) -> DataFrame:
    """Vectors of one model, without superseded rows; other models' folders are not read.

    Unknown names are errors.
    """
    found = read_store(spark, root).where(F.col("model") == model)
    if found.isEmpty():
        raise ValueError(f"Unknown model: {model}")
    return without_superseded(found, root)


def store_superseded(rows: DataFrame, root: str, model: str, batch: str) -> None:
    """List ``id, version`` rows of a collection that a newer version replaces."""
    writer = rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch").parquet(_folder(f"{root}/_superseded", model))


def without_superseded(stored: DataFrame, root: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Stored rows that no newer version replaces. A row that was loaded without one has version 1.

    What is listed is small beside the store, and broadcast if it is counted to fit.
    """
    spark = stored.sparkSession
    schema = "id string, version long, model string, batch string"
    try:
        listed = spark.read.schema(schema).parquet(f"{root}/_superseded").select("model", "id", "version").distinct()
    except AnalysisException:  # nothing was ever listed
        return stored
    count, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("id")), F.lit(0))).head()
    if not count:
        return stored
    named = listed.withColumnsRenamed({"model": "_model", "id": "_id", "version": "_version"})
    side = F.broadcast(named) if size + 48 * count <= broadcast_bytes else named
    same = (F.col("model") == F.col("_model")) & (F.col("id") == F.col("_id")) & (F.coalesce("version", F.lit(1)) == F.col("_version"))
    return stored.join(side, same, "left_anti")


def identified(rows: DataFrame) -> DataFrame:
    """Rows without an id are known by their text: the id becomes ``text:`` and its SHA-256."""
    by_text = F.concat(F.lit("text:"), F.sha2(F.coalesce("document", F.lit("")).cast("binary"), 256))
    return rows.withColumn("id", F.coalesce(F.col("id").cast("string"), by_text))


def _stored(vectors: DataFrame, root: str, model: str) -> DataFrame:
    fields = [f for f in VECTORS.fields if f.name not in ("model", "cell", "batch")]
    present = vectors.columns
    rows = vectors.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )
    tree = stored_cells(vectors.sparkSession, root, model)
    if tree is None:
        return rows.withColumn("cell", F.lit(NO_CELL).cast("bigint"))
    # A vector that is null, or has no direction, is in no cell.
    rows = assigned(rows, tree, tree_dim(tree)).withColumn("cell", F.coalesce(F.try_element_at("cells", F.lit(1)), F.lit(NO_CELL)))
    # The rows of a cell meet, so that a load writes few files; a hot cell is cut by the hint.
    return rows.drop("cells").hint("rebalance", "cell")


def _cells_path(root: str, model: str) -> str:
    return _folder(f"{root}/_cells", model)  # a name that readers of the store pass over


def store_cells(root: str, model: str, tree: CellTree) -> None:
    """Keep the centroids of a collection; what is loaded from now on goes by cell.

    Vectors loaded before keep the cells they have: rebuild the collection, or train first.
    """
    path = _cells_path(root, model)
    tree.centroids.withColumn("space", F.lit(tree.space)).write.mode("overwrite").parquet(f"{path}/centroids")
    tree.groups.write.mode("overwrite").parquet(f"{path}/groups")


def stored_cells(spark: SparkSession, root: str, model: str) -> CellTree | None:
    """The collection's centroids, or None."""
    path = _cells_path(root, model)
    try:
        centroids = spark.read.parquet(f"{path}/centroids")
    except AnalysisException:
        return None
    space = centroids.select("space").head()
    return CellTree(centroids.drop("space"), spark.read.schema(GROUPS).parquet(f"{path}/groups"), space[0] if space else "cosine")


def store_probes(spark: SparkSession, root: str, model: str, probes: int) -> None:
    """Keep the number of cells that a search of the collection probes."""
    spark.createDataFrame([(probes,)], "probes int").write.mode("overwrite").parquet(f"{_cells_path(root, model)}/probes")


def stored_probes(spark: SparkSession, root: str, model: str) -> int | None:
    try:
        row = spark.read.parquet(f"{_cells_path(root, model)}/probes").head()
    except AnalysisException:
        return None
    return row[0] if row else None


def tree_dim(tree: CellTree) -> int:
    first = tree.groups.select(F.size("center")).head()
    return first[0] if first else 0


def index_append(rows: DataFrame, root: str, model: str, embed: Embedder = hashed_terms, batch: str | None = None) -> None:
    """Embed and add ``id, document, metadata`` rows. A given ``batch`` replaces itself."""
    loaded = _stored(embed(identified(rows)), root, model).withColumn("batch", F.lit(batch or uuid.uuid4().hex))
    writer = loaded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("cell", "batch").parquet(_folder(root, model))


def index_rebuild(rows: DataFrame, root: str, model: str, embed: Embedder = hashed_terms) -> None:
    """Replace the whole collection of one model; other models stay."""
    loaded = _stored(embed(identified(rows)), root, model).withColumn("batch", F.lit("rebuild"))
    loaded.write.mode("overwrite").partitionBy("cell", "batch").parquet(_folder(root, model))


def unseen(rows: DataFrame, existing: DataFrame, key: str = "id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows whose key is not stored yet.

    A load is mostly small beside what is stored. If its keys fit a broadcast, the stored
    keys that occur in it are found by scanning the store without a shuffle, and only those
    are taken away. Larger loads meet the store in a shuffled anti join.
    """
    keys = rows.select(key).distinct()
    count, size = keys.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0))).head()
    stored = existing.select(key)
    if size + 16 * count <= broadcast_bytes:
        stored = stored.join(F.broadcast(keys), key, "left_semi")
    return rows.join(stored, key, "left_anti")


def index_resume(
    rows: DataFrame, root: str, model: str, embed: Embedder = hashed_terms, batch: str | None = None
) -> None:
    """Embed and add only rows whose id is not stored yet; running it again adds nothing.

    Among several rows of one id, the one with the lowest document hash is taken; a row without
    an id is known by its text (``identified``). The load's
    own folder does not count as stored, so a repeated load gives the same rows.
    """
    load = batch or uuid.uuid4().hex
    rows = identified(rows)
    stored = read_store(rows.sparkSession, root).where((F.col("model") == model) & (F.col("batch") != load))
    # Stored ids go first, so the exchange of the second step carries new documents only.
    fresh = dedup_first_seen(unseen(rows, stored), "id", F.xxhash64("document"))
    index_append(fresh, root, model, embed, load)
