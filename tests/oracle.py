"""Side-by-side comparison of a registered query and its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(frame, connection, sql) -> str | None:
    """None when equal, else a short description."""
    names, got = normalised(frame.columns, [tuple(row) for row in frame.collect()])
    relation = connection.sql(sql)
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    mine = {name: TYPES.get(kind, kind) for name, kind in frame.dtypes}
    if mine != theirs:
        return f"types {set(mine.items()) ^ set(theirs.items())}"
    expected_names, expected = normalised(relation.columns, relation.fetchall())
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}; e.g. {sorted(set(got) ^ set(expected), key=repr)[:2]}"
    for mine, theirs in zip(got, expected):
        if mine != theirs:
            return f"{str(mine)[:700]} != {str(theirs)[:700]}"
    return None
