"""Compares a Spark result with DuckDB's, whatever the order of rows and columns."""

import decimal
import math
import os

import duckdb
import pandas as pd


def connection(folder):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
            c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path}'")
    return c


def value(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(map(value, v))
    try:
        return None if pd.isna(v) else v
    except (TypeError, ValueError):
        return v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(value, r)) for r in df[columns].itertuples(index=False)), key=repr)
