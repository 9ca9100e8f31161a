"""Run a registered query and its SQL twin and compare the rows."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _cell(v: object) -> object:
    """Comparable form of a cell: numbers as floats, missing as None, the rest as text."""
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (bool, str)):
        return str(v)
    if hasattr(v, "item"):
        return _cell(v.item())
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else float(v)
    return str(v)


def _sort_key(row: tuple) -> tuple:
    return tuple("" if v is None else f"{v:025.4f}" if isinstance(v, float) else v for v in row)


def _same(a: object, b: object) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        # one unit of the sixth decimal: both engines round sums taken in different order
        return a == b or abs(a - b) <= 1.5e-6 * max(1.0, abs(a) * 1e-3)
    return a == b


def normal_form(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(_cell(v) for v in row) for row in df[columns].itertuples(index=False, name=None)), key=_sort_key)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    """None when equal, else a short description."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    a, b = normal_form(spark_df), normal_form(sql_df)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows; only spark {[r for r in a if r not in b][:2]}; only sql {[r for r in b if r not in a][:2]}"
    wrong = [(x, y) for x, y in zip(a, b) if not all(map(_same, x, y))]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
