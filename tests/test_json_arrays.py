"""Splittable JSON arrays equal the reader that takes a file as one."""

import json
import random

import pytest

from abstracta.sources.json_arrays import json_objects
from abstracta.sources.snapshot import read_snapshot

SCHEMA = "id long, t string, o struct<a:string,b:array<string>,c:struct<d:string>>, m map<string,string>"


def entries(n, rng):
    nasty = ['plain', 'é ü 梦 😀', 'a } b { c', '"quoted" } {', 'back\\slash', '\\', '\\"', '}', '{', '[{"x": 1}]', 'line\nfeed\ttab', '', '","', ' ']
    made = []
    for i in range(n):
        pick = lambda: "".join(rng.choice(nasty) for _ in range(rng.randint(0, 4)))
        made.append({"id": i, "t": pick(), "o": rng.choice([None, {}, {"a": pick(), "b": [pick(), pick()], "c": {"d": pick()}}]), "m": {pick() or "k": pick()}})
    return made


@pytest.mark.parametrize("style", [{"indent": 4}, {"indent": 1, "ensure_ascii": False}, {}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_equals_the_whole_file_reader(spark, tmp_path, style):
    rng = random.Random(str(style))
    for name, n in (("big", 900), ("one", 1), ("none", 0), ("small", 30)):
        (tmp_path / f"{name}.json").write_text(json.dumps(entries(n, rng), **style), "utf-8")
    path = str(tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2048)
    spark.conf.set("spark.sql.files.openCostInBytes", 64)
    try:
        parts = spark.read.option("lineSep", "}").text(path + "/big.json").rdd.getNumPartitions()
        split = read_snapshot(spark, path, SCHEMA).collect()
        texts = [json.loads(r["value"]) for r in json_objects(spark, path + "/big.json").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = read_snapshot(spark, path, SCHEMA, splittable=False).collect()
    assert parts > 20
    assert sorted(split, key=repr) == sorted(whole, key=repr) and len(split) == 931
    assert sorted(texts, key=lambda e: e["id"]) == json.loads((tmp_path / "big.json").read_text("utf-8"))


def test_objects_longer_than_a_split_and_values_between(spark, tmp_path):
    long = {"id": 7, "t": "x } { " * 3000, "o": {"a": "y" * 5000, "b": ["}"] * 400}}
    values = [1, "loose } { string", long, None, [], {"id": 8}, "end \\", long]
    (tmp_path / "f.json").write_text("\n " + json.dumps(values) + " \n", "utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1024)
    try:
        got = [json.loads(r["value"]) for r in json_objects(spark, str(tmp_path / "f.json")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(str, got)) == sorted(map(str, [long, {"id": 8}, long]))


def test_files_without_objects(spark, tmp_path):
    for name, text in (("a", "[]"), ("b", ""), ("c", "\n[\n]\n"), ("d", '["}"]')):
        (tmp_path / f"{name}.json").write_text(text)
    assert json_objects(spark, str(tmp_path)).collect() == []
