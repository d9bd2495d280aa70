"""Run a query and its SQL on the same tables and compare rows without order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else str(p) + '/*.parquet'}')")
    return con


def norm(df: pd.DataFrame) -> list[tuple]:
    def one(v):  # noqa: ANN001, ANN202
        if v is None or v is pd.NaT or v is pd.NA:
            return "null"
        if isinstance(v, (list, tuple, np.ndarray)):
            return "[" + ",".join(one(x) for x in v) + "]"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (float, np.floating)):
            return "nan" if np.isnan(v) else f"{float(v) + 0.0:.9g}"
        if isinstance(v, (int, np.integer)):
            return f"{float(v):.9g}" if abs(int(v)) < 1 << 50 else str(int(v))
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def spark_rows(df) -> pd.DataFrame:  # noqa: ANN001
    """A query's rows with null and NaN apart, which toPandas makes one of."""
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> pd.DataFrame:
    got = con.execute(sql)
    return pd.DataFrame(got.fetchall(), columns=[c[0] for c in got.description], dtype=object)


def differ(mine: pd.DataFrame, theirs: pd.DataFrame) -> str:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} and {sorted(theirs.columns)}"
    a, b = norm(mine), norm(theirs)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
