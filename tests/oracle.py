"""Compares a query's rows with those of its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if hasattr(x, "as_tuple"):  # a decimal
        return round(float(x), 5) + 0.0
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    theirs = con.execute(sql)
    names, wanted = [d[0] for d in theirs.description], theirs.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, not {sorted(names)}"
    a, b = rows_of(df.columns, df.collect()), rows_of(names, wanted)
    if len(a) != len(b):
        return f"{len(a)} rows, not {len(b)}"
    return next((f"{x} is not {y}" for x, y in zip(a, b) if x != y and not all(u == v or isinstance(u, (int, float)) and isinstance(v, (int, float)) and abs(u - v) <= 2e-5 for u, v in zip(x, y))), "")
