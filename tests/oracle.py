"""Runs a query beside its oracle and compares rows regardless of order."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, connection, sql):
    found = connection.execute(sql)
    want = rows_of([d[0] for d in found.description], found.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    assert got[1] == want[1], [x for x in zip(got[1], want[1]) if x[0] != x[1]][:3]
