"""A query beside its SQL: the same columns, number of rows, and values in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 4)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], sorted(repr([plain(r[k]) for k in order]) for r in rows)


def compared(spark, con, folder: str, run, sql: str) -> str:
    """Empty if equal; else what differs."""
    df = run(spark, folder)
    names, ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    theirs_names, theirs = rows_of([c[0] for c in found.description], found.fetchall())
    if names != theirs_names:
        return f"columns {names} and {theirs_names}"
    if not ours:
        return "no rows"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    return next((f"{a} and {b}" for a, b in zip(ours, theirs, strict=True) if a != b), "")
