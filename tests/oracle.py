"""Rows of a query and of its SQL in DuckDB, made comparable."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql, sf_dir, **frames):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if t not in frames and os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    for name, frame in frames.items():
        con.register(name, frame)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(row[k] for k in order)) for row in found.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(r)) for r in df.select(*names).collect())
