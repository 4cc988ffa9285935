"""Compare a query with its SQL run by DuckDB on the same tables: columns by name, rows in any order, doubles to 6 digits."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"create view {t} as select * from read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"create view {t} as select * from read_parquet('{path}')")
    return db


def cell(x):
    if x is None:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return None if math.isnan(x) else (round(float(x), 6) + 0.0 if float(x) % 1 else int(x))
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    if hasattr(x, "isoformat"):
        return x.isoformat().replace("T00:00:00", "")
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, db: duckdb.DuckDBPyConnection) -> str:
    """Empty if equal, else what differs."""
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(names, found.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    return next((f"{a} and {b}" for a, b in zip(mine, theirs) if a != b), "")
