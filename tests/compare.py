"""Comparison of a Spark result with a DuckDB one, whatever the row and column order."""

from __future__ import annotations

import duckdb
import pandas as pd

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    return con


def _cell(x) -> str:
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "NULL"
    if isinstance(x, bool) or (hasattr(x, "dtype") and x.dtype.kind == "b"):
        return str(int(x))
    if isinstance(x, float) or (hasattr(x, "dtype") and x.dtype.kind == "f"):
        return f"{float(x) + 0.0:.6g}"
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_cell, r)) for r in frame.itertuples(index=False))
