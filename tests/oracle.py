"""Spark results held against DuckDB on the same Parquet files."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    out = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            out.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return out


def plain(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype") and not getattr(value, "shape", ()):
        return repr(float(value) + 0.0)
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    names = sorted(frame.columns)
    return sorted(zip(*(map(plain, frame[c].tolist()) for c in names), strict=True))


def assert_same(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> None:
    assert sorted(spark_frame.columns) == sorted(sql_frame.columns)
    assert rows(spark_frame) == rows(sql_frame)
