"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with the bundled tables as views."""
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(item) for item in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(plain, key=repr)


def differences(spark_frame, connection, sql: str) -> str:
    """An empty string if both sides agree, else what differs."""
    names, left = _rows(spark_frame.columns, [tuple(r) for r in spark_frame.collect()])
    cursor = connection.execute(sql)
    other_names, right = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if names != other_names:
        return f"columns {names} != {other_names}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, first {str(wrong[0])[:600]}"
    return ""
