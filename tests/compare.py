"""Run registered queries and compare them with their SQL in DuckDB."""

from __future__ import annotations

import math
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([_cell(r[k]) for k in order] for r in rows), key=repr)


def differences(spark, folder, query, sql, con, tolerance=2e-6) -> str | None:
    """None when equal, else a short description."""
    df = query(spark, folder)
    got_cols = df.columns
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if not got:
        return "no rows"
    exact = sum(a != b for a, b in zip(got, want))
    if exact:
        for a, b in zip(got, want):
            for x, y in zip(a, b):
                same = x == y or (
                    isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance * max(1.0, abs(x))
                )
                if not same:
                    return f"{exact} rows differ, e.g. {a} vs {b}"
        return f"~{exact} rows differ by rounding only"
    return None


def timed(spark, folder, query, sql, con):
    t0 = time.time()
    return differences(spark, folder, query, sql, con), time.time() - t0
