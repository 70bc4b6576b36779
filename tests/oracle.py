"""Compare a query with its SQL over the same tables."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return float(x) if type(x).__name__ == "Decimal" else x


def differences(df, sql: str, con) -> tuple[int, int, list]:
    """Rows of each side, and examples of rows that only one has."""
    names = sorted(df.columns)
    mine = sorted((tuple(value(r[n]) for n in names) for r in df.collect()), key=repr)
    found = con.sql(sql)
    assert sorted(found.columns) == names, (sorted(found.columns), names)
    at = [found.columns.index(n) for n in names]
    theirs = sorted((tuple(value(r[i]) for i in at) for r in found.fetchall()), key=repr)
    a, b = set(mine), set(theirs)
    return len(mine), len(theirs), [names, sorted(a - b, key=repr)[:3], sorted(b - a, key=repr)[:3], len(a - b)] if a != b else []
