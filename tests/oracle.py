"""Compares a query with its SQL in DuckDB, as multisets of rows."""

from __future__ import annotations

import datetime
import glob
import os
from collections import Counter

import duckdb
import math


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def connect(folder):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        src = p if os.path.isfile(p) else f"{p}/*.parquet"
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return db


def compare(spark, folder, query, sql):
    """(rows, rows only in Spark, rows only in SQL, column names differ)."""
    df = query(spark, folder)
    ours = bag(df.columns, df.collect())
    res = connect(folder).execute(sql)
    names = [d[0] for d in res.description]
    theirs = bag(names, res.fetchall())
    return sum(ours.values()), ours - theirs, theirs - ours, sorted(df.columns) != sorted(names)
