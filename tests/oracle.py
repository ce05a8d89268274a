"""Runs a query and its SQL on the same files and compares all values."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(con, sql):
    got = con.sql(sql)
    columns = sorted(got.columns)
    at = [got.columns.index(c) for c in columns]
    return columns, sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())
