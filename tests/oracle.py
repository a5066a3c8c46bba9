"""Comparison of a query with its SQL in DuckDB, without regard to order."""

from __future__ import annotations

import os
from collections import Counter

import duckdb


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def database(folder: str):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def same(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    ours = Counter(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    theirs = Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
