"""Runs a query in Spark and its oracle in DuckDB and compares rows."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    r = con.sql(sql)
    cols = sorted(r.columns)
    spots = [r.columns.index(c) for c in cols]
    return cols, sorted((tuple(norm(x[i]) for i in spots) for x in r.fetchall()), key=repr)
