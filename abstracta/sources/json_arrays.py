"""JSON-array text to its objects, split by split.

A reader cannot split an array at line ends that it may not have. Here the text is cut at every
closing brace while it is read, so any number of tasks can read one file. Whether a split begins
inside a string, and how deep in objects, is not known where it is read. A first pass therefore
tells what each split does to both beginnings; one row for each split is summed up in file order;
the second pass knows its beginning and puts the objects together. Only objects that reach over
the end of a split are joined afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from abstracta.session import scratch_path

_ESCAPE = re.compile(r"\\.", re.S)
#: What may stand in front of an object: anything but a brace, and whole strings.
_BETWEEN = re.compile(r'(?:[^"{]|"(?:[^"\\]|\\.)*")*', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_SUMMARY = "file string, block long, odd long, outside long, inside long"
_PIECES = "file string, block long, n long, begins boolean, ends boolean, value string"


def _effect(piece: str) -> tuple[int, int, int]:
    """Whether the quotes of a piece are odd, and the braces it opens if it begins outside or inside a string."""
    parts = _ESCAPE.sub("", piece).split('"')
    opens = [sum(part.count("{") for part in parts[side::2]) for side in (0, 1)]
    return (len(parts) - 1) & 1, opens[0], opens[1]


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(3)))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split: parity of its quotes, and its depth gained from either beginning."""
    held: dict[tuple[str, int], list[int]] = {}
    for file, block, piece in _by_split(batches):
        state = held.setdefault((file, block), [0, 0, 0])
        odd, *opens = _effect(piece)
        for begun in (0, 1):
            inside = begun ^ state[0]
            state[1 + begun] += opens[inside] - (1 - (inside ^ odd))  # the brace behind the piece closes, outside strings
        state[0] ^= odd
    rows = [(*split, *state) for split, state in held.items()]
    yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "odd", "outside", "inside"), row)) for row in rows], _schema(_SUMMARY))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _objects(begun: dict[tuple[str, int], tuple[int, int]]):
    """Second pass: whole objects, and the parts of those that a split border cuts."""
    schema = _schema(_PIECES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        split, inside, depth, parts, begins, n = None, 0, 0, [], True, 0

        def out(ends: bool) -> tuple:
            return (*split, n, begins, ends, "".join(parts))

        for file, block, piece in _by_split(batches):
            if (file, block) != split:
                if parts:
                    rows.append(out(False))
                split, parts, n = (file, block), [], 0
                inside, depth = begun[split]
                begins = depth <= 0
            odd, *opens = _effect(piece)
            text = piece
            if depth <= 0 and not parts:
                # Between objects: drop what stands in front of the next one.
                depth = 0
                at = 0
                if inside and (end := _STRING_END.match(piece)):
                    at = end.end()
                text = piece[_BETWEEN.match(piece, at).end() :] if opens[inside] else ""
                begins = True
            closed = 1 - (inside ^ odd)
            depth += opens[inside] - closed
            inside ^= odd
            if text or parts or (depth > 0) or not begins:
                parts.append(text + "}")
            if closed and depth <= 0 and parts:
                rows.append(out(True))
                parts, begins, n = [], True, n + 1
            if len(rows) >= 4096:
                yield _batch(rows, schema)
                rows = []
        if parts:
            rows.append(out(False))
        yield _batch(rows, schema)

    return task


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """``file, value``: the text of every object of the arrays under ``path``.

    Objects may nest; strings may hold braces, brackets, quotes and escapes. What stands between
    objects (brackets, commas, white space, other values) is left out. A file that ends inside
    an object gives it with a brace behind it, which a parser then refuses or mends. The text is
    read twice and the objects are landed once in the shared folder.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    splits = pieces.mapInArrow(_summaries, _SUMMARY)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun_inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    splits = splits.withColumn("within", begun_inside)
    gained = F.when(F.col("within") == 0, F.col("outside")).otherwise(F.col("inside"))
    splits = splits.withColumn("gained", gained).withColumn("depth", F.coalesce(F.sum("gained").over(before), F.lit(0)))
    # A row for each split, as many as the driver plans tasks for.
    begun = {(r["file"], r["block"]): (int(r["within"]), int(r["depth"])) for r in splits.select("file", "block", "within", "depth").collect()}
    landed = scratch_path(spark, "json-objects")
    pieces.mapInArrow(_objects(begun), _PIECES).write.parquet(landed)
    made = spark.read.schema(_PIECES).parquet(landed)
    whole = made.where("begins and ends").select("file", "value")
    # Two parts of a split at most are cut off; a very long object has one in each of its splits.
    cut = made.where("not (begins and ends)")
    number = F.sum(F.col("begins").cast("long")).over(Window.partitionBy("file").orderBy("block", "n"))
    parts = cut.withColumn("number", number).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "n", "value"))).alias("parts"))
    joined = parts.select("file", F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))
    return whole.unionByName(joined)


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of the arrays under ``path`` as rows of ``schema``."""
    return json_objects(spark, path).select(F.from_json("value", schema).alias("entry")).select("entry.*")
