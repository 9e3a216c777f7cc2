"""Runs a query's SQL in DuckDB over the same tables and compares all rows."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def shown(value) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(shown, value)) + "]"
    return str(value)


def bag(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert bag(df.columns, map(tuple, df.collect())) == bag(columns, result.fetchall())
