"""Holds a Spark result against DuckDB's answer to the same question."""

import glob
import os

import duckdb
import pandas as pd


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET threads = 4")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS FROM '{path}'")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, pd.Timestamp):
            return str(v.tz_localize(None) if v.tzinfo else v)[:19]
        if hasattr(v, "isoformat"):
            text = v.isoformat().replace("T", " ")
            return text if len(text) > 10 else f"{text} 00:00:00"
        if isinstance(v, int | float) or hasattr(v, "dtype"):
            return float(v) + 0.0
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(([plain(v) for v in row] for row in frame.itertuples(index=False)), key=lambda r: [(v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r])


def differences(spark_rows: pd.DataFrame, duck_rows: pd.DataFrame) -> str:
    """What differs, or an empty text."""
    if sorted(spark_rows.columns) != sorted(duck_rows.columns):
        return f"columns {sorted(spark_rows.columns)} and {sorted(duck_rows.columns)}"
    a, b = rows_of(spark_rows), rows_of(duck_rows)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, as {wrong[0]}" if wrong else ""
