"""Rows of Spark and of DuckDB as comparable lists."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    return repr(round(x, 9)) if isinstance(x, float) else str(x)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(r[n]) for n in names) for r in df.collect())


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    found = [d[0] for d in cur.description]
    names = sorted(found)
    at = [found.index(n) for n in names]
    return names, sorted(tuple(cell(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in cur.fetchall())
