"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.sql("set threads to 4")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        db.sql(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return db


def rows(df: pd.DataFrame) -> Counter:
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else float(x) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    return Counter(tuple(plain(x) for x in r) for r in df.astype(object).itertuples(index=False))


def compare(spark, db, sf_dir: str, query, sql: str) -> str:
    """What differs, "" if nothing."""
    got = query(spark, sf_dir).toPandas()
    want = db.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns if got[c].dtype.kind != want[c].dtype.kind}
    a, b = rows(got), rows(want)
    if a != b:
        return f"{len(got)} and {len(want)} rows; only here {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}; kinds {kinds}"
    return f"kinds {kinds}" if kinds else ""
