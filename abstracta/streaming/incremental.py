"""Keep a vector table current from a folder of re-harvested snapshots.

The stream keeps, for each id, a digest of the text and a version in its own state. A row comes
out only if its id is unseen or its text has changed; the store is not scanned for that (only
once, when a stream starts on a collection that holds rows already). A changed text is stored
with the next version, and the version before it is listed as superseded; ``open_collection``
leaves superseded rows out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from abstracta.plans.index import (
    Embedder, create_store, hashed_terms, identified, index_append, read_store, store_superseded, without_superseded,
)

ROWS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("document", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
CHANGED = T.StructType([*ROWS, T.StructField("version", T.LongType())])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def digest(column: str = "document"):
    """What a text is known by; a null text is the empty one."""
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


class Changes(StatefulProcessor):
    """Lets through the first row of an id, and rows whose text differs from the last one's.

    Of several rows of one id in a micro-batch the one with the lowest digest counts. Rows pass
    one at a time, so an id may have any number of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "digest string, version long")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N802, N803
        self.seen.update((initialState["digest"], int(initialState["version"])))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        best = min(rows, key=lambda row: row["digest"], default=None)
        if best is None:
            return
        known = self.seen.get() if self.seen.exists() else None
        if known is None or known[0] != best["digest"]:
            version = known[1] + 1 if known else 1
            self.seen.update((best["digest"], version))
            yield Row(id=best["id"], document=best["document"], metadata=best["metadata"], version=version)

    def close(self) -> None:
        pass


def changed_rows(arriving: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Unseen and changed rows of a stream of ``id, document, metadata``, with their ``version``.

    ``stored`` (``id, document, version``) is what the stream knows when it starts for the first
    time.
    """
    rows = identified(arriving).withColumn("digest", digest())
    begun = None
    if stored is not None:
        version = F.coalesce("version", F.lit(1))
        # One row for each id: its newest version.
        newest = stored.groupBy("id").agg(F.max_by(digest(), version).alias("digest"), F.max(version).alias("version"))
        begun = newest.groupBy("id")
    return rows.groupBy("id").transformWithState(Changes(), CHANGED, "Append", "None", initialState=begun)


def incremental_index(
    spark: SparkSession, source: str, root: str, model: str, checkpoint: str,
    embed: Embedder = hashed_terms, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Index the unseen and changed rows of every new Parquet file under ``source``, then stop.

    A micro-batch may be delivered twice. Its state starts from the version before it, so it
    gives the same rows, which replace the folder named after the checkpoint and its number.
    """
    create_store(spark, root)
    name = hashlib.md5(checkpoint.encode()).hexdigest()

    def add(batch: DataFrame, number: int) -> None:
        load = f"{name}-{number}"
        index_append(batch, root, model, embed, load)
        store_superseded(batch.where("version > 1").select("id", (F.col("version") - 1).alias("version")), root, model, load)

    stored = without_superseded(read_store(spark, root).where(F.col("model") == model), root)
    arriving = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # keyed state with several versions; a query keeps its own copy of the setting
    try:
        changed = changed_rows(arriving, stored.select("id", "document", "version"))
        return (
            changed.writeStream.foreachBatch(add)
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
