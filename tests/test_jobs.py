"""Sources, exports, index life cycle and streaming, end to end on small inputs."""

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from abstracta import session
from abstracta.plans import exports, harvest, index
from abstracta.sources import pages, snapshot, textfiles
from abstracta.streaming.incremental import incremental_index


def content(rows):
    return {k: json.dumps(v) if not isinstance(v, str) else v for k, v in rows.items()}


def notes(spark, *rows):
    return spark.createDataFrame([(i, content(r)) for i, r in enumerate(rows)], "pos int, content map<string,string>")


NOTES = [
    {"title": {"value": "Good title"}, "pdf": {"value": "/pdf/1.pdf"}, "keywords": {"value": ["a", "b"]}, "venue": {"value": "V"}, "tldr": "short"},
    {"title": {"value": "Nullified"}},
    {"title": "abcd"},
    {"abstract": {"value": "no title"}},
]


def test_normalisers_differ_by_parameters(spark):
    loose = harvest.normalize_notes(notes(spark, *NOTES), renames={"pdf": "link"})
    strict = harvest.normalize_notes(notes(spark, *NOTES), shortest_title=5)
    assert sorted(r["pos"] for r in loose.collect()) == [0, 2, 3]
    assert [r["pos"] for r in strict.collect()] == [0]
    entry = loose.where("pos = 0").head()["content"]
    assert entry["link"] == "https://openreview.net/pdf/1.pdf" and "pdf" not in entry
    assert strict.head()["content"]["pdf"] == "https://openreview.net/pdf/1.pdf"


def test_notes_become_canonical_papers(spark):
    cleaned = harvest.normalize_notes(notes(spark, *NOTES), renames={"pdf": "link"})
    paper = harvest.notes_to_papers(cleaned, F.lit(None).cast("string"), F.lit("2025"), F.lit("Submitted")).where("pos = 0").head()
    assert (paper["title"], paper["keywords"], paper["venue"], paper["year"]) == ("Good title", ["a", "b"], "V", 2025)
    assert paper["link"].endswith("/pdf/1.pdf") and paper["extra"] == {"tldr": "short"}


LIST = """<dl><dt class="ptitle"><br><a href="/c/a.html">List A</a></dt>
<dt class="ptitle"><a href="/c/b.html">List B &amp; C</a></dt><dt class="ptitle"><a href="/c/a.html">Again</a></dt>
<dt class="ptitle"><a href="/c/n.html">Nullified</a></dt></dl>"""
DETAIL = """<div id="papertitle">Detail <i>A</i></div><div id="authors"><b><i>X Y,  Z &amp; W,</i></b></div>
<div id="abstract"> Some
text. </div><a href="../bib/a.bib">[BibTeX]</a><div class="bibref pre-white-space"><pre>
@inproceedings{a,
 title = {A}
}
</pre></div>"""


def test_proceedings_harvest(spark):
    lists = spark.createDataFrame([(0, "https://p.org/C2024", LIST)], "page_id int, url string, html string")
    details = spark.createDataFrame([("https://p.org/c/a.html", DETAIL)], "url string, html string")
    got = harvest.harvest_proceedings(lists, details, " cvpr", "2024", F.lit("https://p.org"))
    rows = {r["link"]: r.asDict() for r in got.collect()}
    assert set(rows) == {"https://p.org/c/a.html", "https://p.org/c/b.html"}
    a, b = rows["https://p.org/c/a.html"], rows["https://p.org/c/b.html"]
    assert (a["title"], a["authors"], a["abstract"]) == ("Detail A", ["X Y", "Z & W"], "Some\ntext.")
    assert a["_bibtex"] == "@inproceedings{a,\n title = {A}\n}" and a["bibtex_url"] == "https://p.org/bib/a.bib"
    assert (a["conference"], a["year"]) == ("CVPR", 2024)
    assert (b["title"], b["authors"], b["abstract"], b["_bibtex"]) == ("List B & C", [], None, None)


def test_list_fallback_and_plain_bibref(spark):
    page = '<a href="/html/x.html">X</a><a href="/other">O</a><div class="bibref">@m{k}</div>'
    rows = spark.createDataFrame([("https://p.org/l", page)], "url string, html string")
    links = pages.with_fallback(pages.titled_links(F.col("html")), pages.marked_links(F.col("html")))
    got = pages.explode_links(rows, links, F.col("url")).collect()
    assert [(r["title"], r["detail_url"]) for r in got] == [("X", "https://p.org/html/x.html")]
    record = pages.extract_details(rows).head()
    assert record["bibtex"] == "@m{k}" and record["title"] is None and record["authors"] == []


def test_json_snapshot_is_one_array_per_file(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"é\n{i}", None if i % 2 else "x") for i in range(25)], "id int, t string, n string")
    snapshot.write_json_array(rows, str(tmp_path / "s"), rows_per_file=10)
    parts = sorted((tmp_path / "s").glob("part-*"))
    loaded = [entry for part in parts for entry in json.loads(part.read_text("utf-8"))]
    assert len(parts) == 3 and len(loaded) == 25 and "é" in parts[0].read_text("utf-8") and "n" in loaded[1]
    back = snapshot.read_snapshot(spark, str(tmp_path / "s"), rows.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_snapshots_stay_apart(spark, tmp_path):
    path = str(tmp_path / "t")
    for stamp, n in (("2025-01-01 00:00:00", 3), ("2025-01-02 00:00:00", 2)):
        rows = spark.range(n).select(
            "id", F.lit("ICLR").alias("venue"), F.lit(2025).alias("year"), F.to_timestamp(F.lit(stamp)).alias("snapshot_ts")
        )
        snapshot.write_snapshot(rows, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 5 and snapshot.latest_snapshot(stored).count() == 2


BIB = "@inproceedings{{k{0},\n  title = {{T{0}}}\n}}"


def records(spark, n):
    return spark.range(1, n + 1).select(
        F.lit("q").alias("query_id"), F.col("id").alias("rank"), F.format_string("Title %d", "id").alias("title"),
        F.lit("ICLR 2025").alias("venue"), F.format_string("https://x.org/%d.pdf", "id").alias("link"),
        (F.lit(1) - F.col("id") / 1000).alias("score"),
        F.expr("'@inproceedings{k' || id || ',\n  title = {T' || id || '}\n}'").alias("bibtex"),
    )


@pytest.mark.parametrize("splittable", [True, False])
def test_export_round_trip(spark, tmp_path, splittable):
    path = str(tmp_path / "e")
    textfiles.write_export(exports.export_results(records(spark, 30)), path)
    blocks = textfiles.read_export_blocks(spark, path, splittable)
    parsed = exports.complete_entries_only(exports.parse_export_entry(blocks)).orderBy("pos").collect()
    assert [r["title"] for r in parsed] == [f"Title {i}" for i in range(1, 31)]
    manifest = exports.download_manifest(blocks).orderBy("rank").collect()
    assert manifest[0]["file_name"] == "01 - 1.00 - ICLR 2025 - Title 1.pdf"
    assert [r["rank"] for r in manifest] == list(range(1, 31))
    bib = exports.extract_bibtex(blocks, "file", "pos").orderBy("pos").collect()
    assert [r["bibtex"] for r in bib] == [BIB.format(i) for i in range(1, 31)]


def test_split_reading_equals_whole_reading(spark, tmp_path):
    text = "-------first\n" + "-" * 5 + "second--\n" + "-" * 137 + "\nthird - -- ---- x" + "-" * 12 + "fourth\n" * 3000 + "-----"
    (tmp_path / "f.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        split = textfiles.read_export_blocks(spark, str(tmp_path / "f.txt")).orderBy("pos").collect()
        whole = textfiles.read_export_blocks(spark, str(tmp_path / "f.txt"), splittable=False).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [p for p in re.split(r"-{5,}", text) if p]
    assert [r["value"] for r in split] == expected == [r["value"] for r in whole]
    assert [r["pos"] for r in split] == list(range(len(expected)))


def parse(spark, *entries):
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(entries)], "pos int, value string")
    return exports.parse_export_entry(rows).orderBy("pos").collect()


def test_entry_parsing_corner_cases(spark):
    good = "Title: A\nVenue: V\nLink: https://x/a.pdf?y\nAffinity Score: 0.5\n"
    rows = parse(
        spark, good, good.replace(".pdf", ".html"), good.replace("Venue: V\n", ""), good.replace("0.5", "1.2.3"),
        good.replace("0.5", "-0.5"), good.replace("Title: A", "Title:"), good.replace("A", "a b\r", 1),
        "Link: https://x/a.pdf\nLink: https://x/b.pdf",
    )
    assert [r["link"] for r in rows[:2]] == ["https://x/a.pdf", None]
    assert rows[2]["venue"] is None and rows[3]["affinity"] is None and rows[4]["affinity"] is None
    assert rows[5]["title"] == "Venue: V"  # white space crosses the line end
    assert rows[6]["title"] == "a b" and rows[7]["link"] == "https://x/a.pdf"
    assert rows[0]["affinity"] == 0.5


def test_bibtex_ends_at_a_line_that_starts_with_a_brace(spark):
    closed = "BibTeX:\n@a{x,\n t={1}}\n-----\nTitle: t\nBibTeX:\n@b{y,\n t={2}\n}\n"
    whole = spark.createDataFrame([(closed,)], "value string")
    blocks = spark.createDataFrame([(b,) for b in re.split("-{5,}", closed)], "value string")
    ran_on = [r["bibtex"] for r in exports.extract_bibtex(whole).collect()]
    assert ran_on == re.findall(r"BibTeX:\s*\n(@[\s\S]*?\n})", closed) and len(ran_on) == 1
    assert [r["bibtex"] for r in exports.extract_bibtex(blocks).collect()] == ["@b{y,\n t={2}\n}"]


@pytest.mark.parametrize("rows_per_file, files", [(100, 1), (4, 3)])
def test_bib_file(spark, tmp_path, rows_per_file, files):
    entries = spark.createDataFrame([(i, BIB.format(i)) for i in range(10)], "pos int, bibtex string")
    exports.write_bibtex(entries, ["pos"], str(tmp_path / "b"), rows_per_file)
    parts = sorted((tmp_path / "b").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "\n\n".join(BIB.format(i) for i in range(10)) + "\n"
    assert len(parts) == files


def test_bib_file_with_ties_and_nulls_evaluates_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(1, "@a{1}"), (1, "@b{1}"), (1, "@a{1}"), (None, "@n{0}"), (2, None), (0, ""), (2, "@c{2}")]
    entries = spark.createDataFrame(rows, "pos int, bibtex string")
    exports.write_bibtex(entries.mapInArrow(watched, entries.schema), ["pos"], str(tmp_path / "b"), 2)
    parts = sorted((tmp_path / "b").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "\n\n".join(["@n{0}", "@a{1}", "@a{1}", "@b{1}", "@c{2}"]) + "\n"
    assert len(parts) > 1 and seen.value == len(rows)
    with pytest.raises(ValueError, match="No BibTeX"):
        exports.write_bibtex(entries.where("bibtex is null"), ["pos"], str(tmp_path / "c"))


def test_no_bibtex_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="No BibTeX"):
        exports.write_bibtex(spark.createDataFrame([], "pos int, bibtex string"), ["pos"], str(tmp_path / "b"))


def documents(spark, ids):
    return spark.createDataFrame(
        [(str(i), f"text {i}", {"n": str(i)}) for i in ids], "id string, document string, metadata map<string,string>"
    )


def stored_ids(spark, root, model="m"):
    return sorted(int(r["id"]) for r in index.read_store(spark, root).where(F.col("model") == model).collect())


def test_index_life_cycle(spark, tmp_path):
    root = str(tmp_path / "v")
    index.create_store(spark, root)
    assert index.list_collections(spark, root).count() == 0
    index.index_append(documents(spark, range(5)), root, "m")
    index.index_resume(documents(spark, range(8)), root, "m")
    index.index_resume(documents(spark, range(8)), root, "m")
    assert stored_ids(spark, root) == list(range(8))
    index.index_append(documents(spark, range(3)), root, "other")
    for _ in range(2):
        index.index_rebuild(documents(spark, range(4)), root, "m")
    assert stored_ids(spark, root) == [0, 1, 2, 3] and stored_ids(spark, root, "other") == [0, 1, 2]
    assert {tuple(r) for r in index.list_collections(spark, root).collect()} == {("m", 4), ("other", 3)}
    assert index.open_collection(spark, root, "m").where("size(terms) = 2").count() == 4
    with pytest.raises(ValueError, match="Unknown model: x"):
        index.open_collection(spark, root, "x")


def test_repeated_load_replaces_itself(spark, tmp_path):
    root = str(tmp_path / "v")
    index.create_store(spark, root)
    index.index_append(documents(spark, [1, 2]), root, "m", batch="a")
    for _ in range(2):
        index.index_resume(documents(spark, [2, 3, 3]), root, "m", batch="b")
    assert stored_ids(spark, root) == [1, 2, 3]


def test_rows_without_an_id_are_known_by_their_text(spark, tmp_path):
    root = str(tmp_path / "v")
    index.create_store(spark, root)
    rows = spark.createDataFrame(
        [(None, "a", {}), (None, "b", {}), (None, "a", {}), (None, None, {}), ("1", "a", {})],
        "id string, document string, metadata map<string,string>",
    )
    for _ in range(3):
        index.index_resume(rows, root, "m")
    stored = index.open_collection(spark, root, "m").select("id", "document").collect()
    assert sorted((r["document"] or "", len(r["id"])) for r in stored) == [("", 69), ("a", 1), ("a", 69), ("b", 69)]


def test_stream_equals_batch(spark, tmp_path):
    source, root, state = (str(tmp_path / name) for name in ("s", "v", "c"))
    for ids in ([1, 2, 3], [2, 3, 4], []):
        documents(spark, ids).write.mode("append").parquet(source) if ids else None
        incremental_index(spark, source, root, "m", state).awaitTermination()
    assert stored_ids(spark, root) == [1, 2, 3, 4]


def test_replayed_stream_batch_changes_nothing(spark, tmp_path):
    source, root, state = (str(tmp_path / name) for name in ("s", "v", "c"))
    documents(spark, [1, 2]).write.parquet(source)
    incremental_index(spark, source, root, "m", state).awaitTermination()
    documents(spark, [2, 5]).write.mode("append").parquet(source)
    incremental_index(spark, source, root, "m", state).awaitTermination()
    # The last batch counts as undelivered once its commit record is gone.
    for name in ("1", ".1.crc"):
        record = Path(state) / "commits" / name
        if record.exists():
            record.rename(tmp_path / f"old-{name}")
    incremental_index(spark, source, root, "m", state).awaitTermination()
    assert stored_ids(spark, root) == [1, 2, 5]


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Cluster:
        applicationId, master, folder = "app-x", "yarn", None

        def getCheckpointDir(self):  # noqa: N802
            return self.folder

    class Session:
        sparkContext = Cluster()

        class conf:  # noqa: N801
            get = staticmethod(lambda _key, _default: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    Cluster.folder = "hdfs:///context/uuid/"
    assert session.scratch_path(Session(), "x").startswith("hdfs:///context/uuid/x-")
    Session.conf.get = staticmethod(lambda _key, _default: "hdfs:///shared/")
    assert session.scratch_path(Session(), "x").startswith("hdfs:///shared/x-")
