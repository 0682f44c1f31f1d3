"""Run a catalogue query on Spark and its SQL on DuckDB over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def spark_result(df):
    return by_name(df.columns, [tuple(r) for r in df.collect()])


def sql_result(connection, sql):
    cursor = connection.execute(sql)
    return by_name([d[0] for d in cursor.description], cursor.fetchall())
