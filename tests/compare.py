"""Rows of a query against rows of DuckDB for its SQL."""

import os

import duckdb


def oracle_rows(sf_dir, sql):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    r = c.sql(sql)
    return r.columns, r.fetchall()


def same_rows(df, columns, rows):
    cols = sorted(df.columns)
    assert cols == sorted(columns)
    at = [list(columns).index(c) for c in cols]
    ours = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    theirs = sorted((tuple(r[i] for i in at) for r in rows), key=repr)
    assert ours == theirs
