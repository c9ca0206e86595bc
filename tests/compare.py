"""Run a query and its SQL on the same tables and compare their rows."""

from pathlib import Path

import duckdb
import pandas as pd


def database(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(5) + 0.0
        elif pd.api.types.is_integer_dtype(df[c]):
            df[c] = df[c].astype("int64")
        else:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(got, want):
    """None if both frames hold the same rows, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        if pd.api.types.is_float_dtype(a[c]) and pd.api.types.is_numeric_dtype(b[c]):
            bad = ~(((a[c] - b[c]).abs() <= 2e-5) | (a[c].isna() & b[c].isna()))
        else:
            bad = a[c].astype(str) != b[c].astype(str)
        if bad.any():
            at = bad.idxmax()
            return f"{c}: {int(bad.sum())} differ, first {a.loc[at].to_dict()} and {b.loc[at].to_dict()}"
    return None
