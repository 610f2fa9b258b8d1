"""Compares registered queries with their SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, f, sql, sf_dir):
    df = f(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    assert len(got) == len(want), (name, len(got), len(want), got[:3], want[:3])
    for a, b in zip(got, want):
        assert a == b, (name, a, b)
    return len(got)
