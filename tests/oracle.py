"""Runs a query and its SQL side by side."""

import glob
import math
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def agrees(spark, folder, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    mine = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    r = connect(folder).execute(sql)
    names = [d[0] for d in r.description]
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert sorted(names) == cols
    assert mine == theirs
