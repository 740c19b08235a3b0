"""Comparison of a query with its SQL twin in DuckDB."""

import math
import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, bool):
        return str(v)
    return str(v)


def compare(df, sql, sf):
    c = connection(sf)
    want = c.sql(sql)
    names = want.columns
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    have = sorted(tuple(plain(v) for v in r) for r in want.fetchall())
    # whole doubles print as such on one side only when the types differ
    assert len(got) == len(have)
    assert got == have
