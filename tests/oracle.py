"""Rows of a Spark query held against rows of its SQL in DuckDB."""

from __future__ import annotations

import math
import tempfile
from pathlib import Path

import duckdb

SF_DIR = "/root/testdata/sf0.001"


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute("set memory_limit = '6GB'")
    con.execute(f"set temp_directory = '{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def _cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else 0.0 if x == 0 else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(_cell(y) for y in x)
    return x if isinstance(x, int | str | bytes) else str(x)


def rows(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def same(spark, name: str, query, sql: str, sf_dir: str = SF_DIR) -> None:
    found = query(spark, sf_dir)
    result = connect(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(names), name
    left, right = rows(found.columns, found.collect()), rows(names, result.fetchall())
    assert len(left) == len(right), f"{name}: {len(left)} and {len(right)} rows"
    for a, b in zip(left, right, strict=True):
        assert a == b, f"{name}: {a} and {b}"
