"""Runs a query and its SQL side by side."""

import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def connect(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    con.execute("SET timezone = 'UTC'")
    return con


def both(spark, folder, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = connect(folder).execute(sql)
    names = [x[0] for x in cur.description]
    want = sorted((tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=str)
    return cols, sorted(names), got, want
