"""What several of these operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from abstracta.session import scratch_path

TYPES = {
    "long": pa.int64(),
    "int": pa.int32(),
    "string": pa.string(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
}

#: One byte for every byte: A-Z lowered, ASCII letters and digits and all above kept, the rest a
#: space; the line feed stays to part the blocks.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 or c == 10 else 32 for c in range(256)
)


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, TYPES[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def map_rows(frame: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[tuple]], ddl: str) -> DataFrame:
    """``mapInArrow`` for a function from a batch to tuples of ``ddl``, sent on in bounded batches."""
    schema = arrow_schema(ddl)

    def task(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in rows(batch):
                held.append(row)
                if len(held) >= 4096:
                    yield as_batch(held, schema)
                    held = []
        if held:
            yield as_batch(held, schema)

    return frame.mapInArrow(task, ddl)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def shared(spark: SparkSession, thing: object) -> Callable[[], object]:
    """Broadcast an object of bounded size by its plain fields; a task calls the result.

    A broadcast names classes, which executors without this package could not import; the class
    travels with the task's function instead.
    """
    fields, kind = spark.sparkContext.broadcast(vars(thing)), type(thing)

    def here() -> object:
        made = kind.__new__(kind)
        made.__dict__.update(fields.value)
        return made

    return here


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: cuts the plan, survives executors."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
