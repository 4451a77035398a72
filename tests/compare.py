"""Compare a Spark result with a DuckDB result, whatever the row order."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float) or type(value).__name__ in ("float64", "float32"):
        return None if math.isnan(value) else float(value)
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    if type(value).__module__ == "numpy" and hasattr(value, "item"):
        return value.item()
    return value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    rows = [tuple(_plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, type(v).__name__, str(v)) for v in r))


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame, limit: int = 3) -> list[str]:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return [f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"]
    left, right = rows_of(spark_frame), rows_of(sql_frame)
    found = []
    if len(left) != len(right):
        found.append(f"rows {len(left)} != {len(right)}")
    for a, b in zip(left, right):
        if a != b:
            found.append(f"spark {a}\n   sql   {b}")
            if len(found) > limit:
                break
    return found
