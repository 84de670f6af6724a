"""Incremental indexing with keyed state: unseen and changed rows, restart, replay, batch equality."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from abstracta.plans import index
from abstracta.streaming import incremental
from abstracta.streaming.incremental import incremental_index


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / name) for name in ("source", "root", "state")]


def feed(spark, folders, rows, **options):
    source, root, state = folders
    if rows:
        frame = spark.createDataFrame([(i, t, {"n": t or ""}) for i, t in rows], incremental.ROWS)
        frame.write.mode("append").parquet(source)
    incremental_index(spark, source, root, "m", state, **options).awaitTermination()


def current(spark, folders):
    stored = index.open_collection(spark, folders[1], "m")
    return sorted((r["id"], r["document"]) for r in stored.select("id", "document").collect())


def test_unseen_and_changed_rows_come_out(spark, folders):
    feed(spark, folders, [("1", "a"), ("2", "b"), (None, "no id")])
    feed(spark, folders, [("2", "b"), ("3", "c"), ("1", "a new"), (None, "no id"), ("4", None)])
    feed(spark, folders, [])  # a restart without news
    feed(spark, folders, [("1", "a new"), ("1", "a new"), ("4", ""), ("2", "b new")])
    feed(spark, folders, [("2", "b")])  # back to an earlier text
    got = current(spark, folders)
    assert [row for row in got if not row[0].startswith("text:")] == [("1", "a new"), ("2", "b"), ("3", "c"), ("4", None)]
    assert [row[1] for row in got if row[0].startswith("text:")] == ["no id"]
    versions = {(r["id"], r["version"]) for r in index.read_store(spark, folders[1]).collect() if r["id"] in ("1", "2")}
    assert versions == {("1", 1), ("1", 2), ("2", 1), ("2", 2), ("2", 3)}
    assert index.list_collections(spark, folders[1]).head()["n"] == 5


def test_replayed_batch_with_changes_is_the_same(spark, folders, tmp_path):
    feed(spark, folders, [("1", "a"), ("2", "b")])
    feed(spark, folders, [("2", "b new"), ("3", "c")])
    before = current(spark, folders), index.read_store(spark, folders[1]).count()
    commits = sorted(int(p.name) for p in (Path(folders[2]) / "commits").iterdir() if p.name.isdigit())
    for name in (str(commits[-1]), f".{commits[-1]}.crc"):
        record = Path(folders[2]) / "commits" / name
        if record.exists():
            record.rename(tmp_path / f"old-{name}")
    feed(spark, folders, [])
    assert (current(spark, folders), index.read_store(spark, folders[1]).count()) == before


def test_many_rows_of_one_id_in_a_batch(spark, folders):
    rows = [("hot", f"text {i % 7}") for i in range(400)] + [(str(i), "x") for i in range(20)]
    feed(spark, folders, rows)
    lowest = spark.createDataFrame([(f"text {i}",) for i in range(7)], "document string").orderBy(incremental.digest()).head()[0]
    got = dict(current(spark, folders))
    assert got["hot"] == lowest and len(got) == 21


def test_starts_from_what_batches_have_stored(spark, folders):
    rows = spark.createDataFrame([(str(i), f"t{i}", {}) for i in range(5)], incremental.ROWS)
    index.create_store(spark, folders[1])
    index.index_append(rows, folders[1], "m", batch="first")
    feed(spark, folders, [("0", "t0"), ("1", "other"), ("9", "t9")])
    assert current(spark, folders) == [("0", "t0"), ("1", "other"), ("2", "t2"), ("3", "t3"), ("4", "t4"), ("9", "t9")]
    assert index.read_store(spark, folders[1]).where("batch <> 'first'").count() == 2


def test_equals_the_batch_result(spark, folders, tmp_path):
    harvests = [[(str(i), f"t{i}") for i in range(0, 30)], [(str(i), f"t{i}") for i in range(20, 60)]]
    other = str(tmp_path / "batch")
    index.create_store(spark, other)
    for n, rows in enumerate(harvests):
        feed(spark, folders, rows)
        frame = spark.createDataFrame([(i, t, {"n": t}) for i, t in rows], incremental.ROWS)
        index.index_resume(frame, other, "m", batch=str(n))
    want = sorted((r["id"], r["document"]) for r in index.open_collection(spark, other, "m").collect())
    assert current(spark, folders) == want


def test_the_store_is_not_scanned_for_known_ids(spark, folders, monkeypatch):
    feed(spark, folders, [("1", "a")])
    seen = []
    appended = incremental.index_append
    monkeypatch.setattr(incremental, "index_append", lambda batch, *rest: seen.append(batch._jdf.queryExecution().toString()) or appended(batch, *rest))
    feed(spark, folders, [("1", "a"), ("2", "b")])
    assert seen and not any("model=" in plan and "Join" in plan for plan in seen)
