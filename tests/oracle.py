"""Holds a query against its SQL in DuckDB, the way the driver does."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def plain(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return repr(v)
    return sorted(tuple(plain(t[i]) for i in order) for t in tuples)


def compare(df, sql, sf_dir):
    con = connect(sf_dir)
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert g == w, (g, w)
