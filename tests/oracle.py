"""Runs a registered query beside its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value if value is None or isinstance(value, (int, str, bool)) else str(value)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"create view {path.stem} as select * from read_parquet('{files}')")
    return con


def same_rows(spark, query, sql: str, sf_dir: str) -> int:
    """Asserts that both give the same columns and rows, in any order; returns their number."""
    frame = query(spark, sf_dir)
    found = connect(sf_dir).execute(sql)
    names = sorted(frame.columns)
    assert names == sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want, strict=True):
        assert g == w, (names, g, w)
    return len(got)
