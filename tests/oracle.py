"""Compares a registered query with its DuckDB equivalent."""

import os

import duckdb


def connect(d):
    c = duckdb.connect()
    for t in sorted(os.listdir(d)):
        p = os.path.join(d, t)
        c.execute(f"create view {t.split('.')[0]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(rows):
    def one(v):
        if v is None or v != v:
            return "null"
        return v if isinstance(v, str) else f"{float(v):.9g}"

    return sorted(tuple(one(v) for v in r) for r in rows)


def same(spark, d, query, sql):
    df = query(spark, d)
    cols = sorted(df.columns)
    got = plain([[r[c] for c in cols] for r in df.collect()])
    res = connect(d).execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = plain([[r[names.index(c)] for c in cols] for r in res.fetchall()])
    assert got == want
