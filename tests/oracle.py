"""Compare a Spark result with a DuckDB query on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def run_sql(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con.execute(sql).df()


def normalised(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows sorted, times in one unit."""
    df = df[sorted(df.columns)].copy()
    for name in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[name]):
            df[name] = df[name].astype("datetime64[us]")
        elif pd.api.types.is_integer_dtype(df[name]):
            df[name] = df[name].astype("int64")
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def assert_same(actual: pd.DataFrame, expected: pd.DataFrame) -> None:
    pd.testing.assert_frame_equal(normalised(actual), normalised(expected), check_exact=True)
