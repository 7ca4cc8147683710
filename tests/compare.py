"""Run a query on Spark and its SQL on DuckDB, and compare rows and types."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

KINDS = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "DATE": "date",
    "BOOLEAN": "boolean",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return str(value)


def normal(rows, columns) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def spark_result(df: DataFrame):
    return df.dtypes, [tuple(row) for row in df.collect()]


def duck_result(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = [KINDS.get(str(d[1]), str(d[1])) for d in cursor.description]
    return list(zip(names, kinds)), cursor.fetchall()


def differences(df: DataFrame, con, sql: str) -> list[str]:
    """Empty when both sides agree in names, types and rows."""
    left_types, left = spark_result(df)
    right_types, right = duck_result(con, sql)
    out = []
    if sorted(left_types) != sorted(right_types):
        out.append(f"types differ: {sorted(set(left_types) ^ set(right_types))}")
    a = normal(left, [n for n, _ in left_types])
    b = normal(right, [n for n, _ in right_types])
    if len(a) != len(b):
        out.append(f"rows differ: {len(a)} and {len(b)}")
    odd = [pair for pair in zip(a, b) if pair[0] != pair[1]]
    if odd:
        out.append(f"{len(odd)} rows differ, first: {odd[0]}")
    if not a:
        out.append("no rows")
    return out
