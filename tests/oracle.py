"""Comparison of a Spark result with DuckDB over the same files."""

import glob
import os
from collections import Counter

import duckdb
import pandas as pd


def connection(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        path = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{path}')")
    return con


def rows(frame, columns):
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        if isinstance(v, (bool, str)) or type(v).__name__ == "bool":
            return str(v)
        try:
            return f"{float(v):.8g}"
        except (TypeError, ValueError):
            return str(v)[:19].removesuffix(" 00:00:00")

    return Counter(tuple(text(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


def difference(df, sql, con):
    """Empty if equal, else what differs."""
    a, b = df.toPandas(), con.execute(sql).df()
    columns = sorted(a.columns)
    if columns != sorted(b.columns):
        return f"columns {columns} {sorted(b.columns)}"
    x, y = rows(a, columns), rows(b, columns)
    return "" if x == y else f"only spark {list((x - y).items())[:3]} only sql {list((y - x).items())[:3]}"
