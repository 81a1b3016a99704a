"""Order-free comparison of a DataFrame with checking SQL."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb
from pyspark.sql import DataFrame

from bindings.views import TABLES


def checker(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _cell(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, bool) or x is None:
        return repr(x)
    if isinstance(x, (int, float)):
        if isinstance(x, float) and math.isnan(x):
            return "nan"
        return f"{x:.9g}" if isinstance(x, float) and x != int(x) else str(int(x))
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(_cell(e) for e in x) + "]"
    return str(x)


def _rows(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> dict:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    wanted = _rows(names, cursor.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    in_got, in_wanted = set(got), set(wanted)
    missing = [r for r in wanted if r not in in_got]
    extra = [r for r in got if r not in in_wanted]
    return {
        "columns": sorted(df.columns) == sorted(names),
        "names": (sorted(df.columns), sorted(names)),
        "rows": (len(got), len(wanted)),
        "same": got == wanted,
        "missing": missing[:2],
        "extra": extra[:2],
    }
