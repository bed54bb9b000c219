"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import decimal
import os
from collections import Counter

import duckdb

from pagewright.sources.tables import TABLES

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(repr(tuple(norm(r[i]) for i in order)) for r in data)


def duck(sql, data=DATA):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    r = c.sql(sql)
    return rows(list(r.columns), r.fetchall())


def same(spark, query, sql, data=DATA):
    df = query(spark, data)
    got, want = rows(df.columns, df.collect()), duck(sql, data)
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]))[:2], list((want[1] - got[1]))[:2])
    return got
