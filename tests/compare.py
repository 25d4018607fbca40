"""Rows of a query against rows of DuckDB, whatever the order."""

from __future__ import annotations

import math

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str = SF):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows(raw, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in raw), key=repr)


def of_spark(df):
    return rows(df.collect(), df.columns)


def of_duck(c, sql):
    r = c.execute(sql)
    return rows(r.fetchall(), [d[0] for d in r.description])
