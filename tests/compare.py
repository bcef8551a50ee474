"""Run one registered query in Spark and its SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def canonical(columns, rows):
    """Column names in order of name, and the rows as a sorted list."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def spark_result(df):
    return canonical(df.columns, [tuple(row) for row in df.collect()])


def duck_result(con, sql):
    cursor = con.execute(sql)
    return canonical([c[0] for c in cursor.description], cursor.fetchall())
