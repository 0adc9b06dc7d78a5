"""Runs SQL in DuckDB over a data folder and compares rows regardless of their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def duck(folder=DATA):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(records, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def same(df, sql, folder=DATA):
    c = duck(folder)
    result = c.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    got = df.collect()
    assert sorted(names) == sorted(df.columns)
    assert rows(got, df.columns) == rows(want, names)
