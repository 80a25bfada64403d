"""Runs a query's SQL twin and compares rows, ignoring their order."""

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(d=SF):
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        src = p + "/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{src}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 7)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def same(df, con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())
