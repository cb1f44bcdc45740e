"""Rows of a query and of its SQL in DuckDB, in a form that compares."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    show = lambda v: "null" if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame.itertuples(index=False))


def by_sql(sql: str, sf: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con.execute(sql).df()


def assert_same(got: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
