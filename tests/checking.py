"""Runs a query and its SQL side by side and compares rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data) if all(None not in tuple(r) for r in data) else sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf_dir, con, f, sql):
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    want = rows(names, rel.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert g == w, (g, w)
    return len(got)
