"""Runs a query's SQL on the driver's tables in DuckDB and compares rows."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        where = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{where}'")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows_of_sql(con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=repr)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=repr)
