"""Vectors kept by content, and statistics kept current by a stream."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from abstracta.operators.embed import EmbeddingModel, register_model
from abstracta.operators.stats import venue_year_stats, venue_year_totals
from abstracta.plans import index
from abstracta.plans.vector_cache import cached_embedder
from abstracta.sources.snapshot import latest_snapshot
from abstracta.streaming import counts


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_a_text_is_embedded_once(spark, tmp_path, broadcast_bytes):
    log = str(tmp_path / "embedded")  # the model stays in its worker, so it keeps count in a file

    def load():
        def embed(texts: np.ndarray) -> np.ndarray:
            with open(log, "a") as lines:
                lines.write("".join(f"{t!r}\n" for t in texts.tolist()))
            return np.array([[len(t), 1.0] for t in texts], np.float32)

        return embed

    def embedded() -> list[str]:
        with open(log) as lines:
            return sorted(lines.read().split())

    model = register_model(EmbeddingModel(f"counted-{broadcast_bytes}", 2, load))
    root = str(tmp_path / "v")
    index.create_store(spark, root)
    embed = cached_embedder(root, model.name, broadcast_bytes=broadcast_bytes)
    kind = "id string, document string, metadata map<string,string>"
    rows = spark.createDataFrame([("1", "a", None), ("2", "bb", None), ("3", "a", None), ("4", None, None), ("5", "", None)], kind)
    index.index_append(rows, root, model.name, embed)
    assert embedded() == ["''", "'a'", "'bb'"]
    for _ in range(2):
        index.index_rebuild(rows, root, model.name, embed)
    index.index_resume(rows, root, model.name, embed)
    assert len(embedded()) == 3
    more = rows.unionByName(spark.createDataFrame([("6", "bb", None), ("7", "ccc", None)], kind))
    index.index_resume(more, root, model.name, embed)
    assert embedded() == ["''", "'a'", "'bb'", "'ccc'"]
    stored = {r["id"]: r["embedding"] for r in index.open_collection(spark, root, model.name).collect()}
    assert stored == {"1": [1, 1], "2": [2, 1], "3": [1, 1], "4": [0, 1], "5": [0, 1], "6": [2, 1], "7": [3, 1]}
    index.index_append(rows.limit(0), root, model.name, embed)
    assert len(embedded()) == 4


SCHEMA = "venue string, year int, decision string, snapshot_ts timestamp, id int"
CLASSES = ["oral", "poster"]


def harvest(spark, day, rows):
    stamp = datetime.datetime(2026, 1, day)
    return spark.createDataFrame([(v, y, d, stamp, i) for i, (v, y, d) in enumerate(rows)], SCHEMA)


def test_stream_of_harvests_equals_the_batch_rollup(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("s", "c", "k"))
    harvests = [
        harvest(spark, 1, [("A", 2024, "oral"), ("A", 2024, "poster"), ("B", 2024, "poster"), (None, None, None), ("A", 2025, "x")] * 3),
        harvest(spark, 2, [("A", 2024, "poster"), ("A", 2024, None), ("C", 2025, "oral")] * 2),  # A 2024 again
        harvest(spark, 3, [("B", 2024, "oral")]),
    ]
    schema = harvests[0].schema
    landed = None
    for rows in harvests:
        rows.repartition(3).write.mode("append").parquet(source)
        counts.keep_counts(spark, source, schema, path, state, files_per_batch=2).awaitTermination()
        landed = rows if landed is None else landed.unionByName(rows)
        newest = latest_snapshot(landed)
        want = venue_year_stats(newest, CLASSES)
        got = counts.current_stats(spark, path, CLASSES)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str)
        totals = counts.current_totals(spark, path)
        whole = venue_year_totals(newest)
        assert sorted(map(tuple, totals.select(whole.columns).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert counts.current_counts(spark, path).where("venue = 'A' and year = 2024").agg(F.sum("n")).head()[0] == 4


def test_a_repeated_load_of_counts_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = harvest(spark, 1, [("A", 2024, "oral")] * 5)
    for _ in range(2):
        counts.record_counts(rows, path, "one")
    counts.record_counts(rows.limit(2), path, "two")
    assert counts.current_counts(spark, path).head()["n"] == 7
    assert counts.current_stats(spark, path, CLASSES).head()["oral"] == 7
