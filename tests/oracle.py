"""Runs a query's SQL in DuckDB over the same parquet files and compares rows without regard to order."""

import decimal
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder=DATA):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows_of(columns, order, rows):
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def check(df, sql, con):
    order = sorted(df.columns)
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == order
    assert rows_of(df.columns, order, df.collect()) == rows_of(columns, order, cur.fetchall())
