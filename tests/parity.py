"""Run a registered query and its SQL twin and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(file)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return round(float(value), 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(spark, con, folder, query, text):
    """None when equal, else a short text that says what differs."""
    started = time.time()
    df = query(spark, folder)
    mine = rows_of(df.columns, df.collect())
    spent = time.time() - started
    rel = con.sql(text)
    theirs = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}", len(mine), spent
    if mine != theirs:
        a = [r for r in mine if r not in set(theirs)][:2]
        b = [r for r in theirs if r not in set(mine)][:2]
        return f"rows {len(mine)} vs {len(theirs)}: {a} | {b}"[:1500], len(mine), spent
    return None, len(mine), spent
