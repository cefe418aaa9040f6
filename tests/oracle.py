"""Runs a query's SQL in DuckDB and compares rows, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(columns: list[str], found) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if columns and rows agree, else what doesn't."""
    got_columns = df.columns
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} and {sorted(want_columns)}"
    want = rows(want_columns, result.fetchall())
    got = rows(got_columns, df.collect())
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"
    return ""
