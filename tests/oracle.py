"""Runs a query and its SQL and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(f"{v:.7g}") + 0.0 if isinstance(v, float) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def same(spark, con, sf, query, sql):
    df = query(spark, sf)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    mine, theirs = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=1e-5, abs_tol=2e-6)), (a, b)
