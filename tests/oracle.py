"""Spark results against DuckDB's on the same tables."""

import glob
import math
import os
from collections import Counter

import duckdb

SMALL = "/root/testdata/sf0.001"


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if hasattr(v, "item"):
        return norm(v.item())
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


def same(spark, f, sql, sf=SMALL):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    r = con.sql(sql)
    names, theirs = r.columns, r.fetchall()
    df = f(spark, sf)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = Counter(tuple(norm(x[c]) for c in order) for x in df.collect())
    assert ours == Counter(tuple(norm(x[names.index(c)]) for c in order) for x in theirs)
