"""A Spark query and its SQL, row by row."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    return v


def rows(df):
    names = sorted(df.columns)
    return names, sorted(str([plain(r[c]) for c in names]) for r in df.collect())


def sql_rows(con, sql):
    r = con.sql(sql)
    names = sorted(r.columns)
    at = [r.columns.index(c) for c in names]
    return names, sorted(str([plain(x[i]) for i in at]) for x in r.fetchall())
