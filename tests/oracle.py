"""Compares queries with their SQL on one scale."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else (f"{float(v):.6g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v))
    return sorted(tuple(show(r[k]) or "" for k in order) for r in rows), sorted(names)


def compare(spark, con, sf_dir, query, sql):
    """None, or what differs."""
    df = query(spark, sf_dir)
    got, names = canonical(df.collect(), df.columns)
    res = con.execute(sql)
    want, want_names = canonical(res.fetchall(), [c[0] for c in res.description])
    if names != want_names:
        return f"columns {names} and {want_names}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} rows differ, such as {bad[0]}" if bad else None
