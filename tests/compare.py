"""Runs a query in Spark and its SQL in DuckDB and compares the rows as a multiset."""

from __future__ import annotations

import math
import os
import sys
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("FOLIOSCOPE_TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((_plain(a), _plain(b)) for a, b in v.items()))
    if hasattr(v, "item"):
        return _plain(v.item())
    if isinstance(v, int):
        return float(f"{v:.9g}") if abs(v) < 1e9 else v
    return str(v)


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, query, sql: str, sf_dir: str, con=None) -> str:
    """Empty when both give the same rows; otherwise what differs."""
    df = query(spark, sf_dir)
    con = con or connect(sf_dir)
    cur = con.execute(sql)
    theirs_names = [c[0] for c in cur.description]
    theirs_rows = cur.fetchall()
    ours_rows = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(theirs_names):
        return f"columns {sorted(df.columns)} != {sorted(theirs_names)}"
    a, b = rows_of(df.columns, ours_rows), rows_of(theirs_names, theirs_rows)
    if a == b:
        return ""
    only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"rows {sum(a.values())} vs {sum(b.values())}; only ours {sum((a - b).values())}: {only_a}; only theirs {sum((b - a).values())}: {only_b}"
