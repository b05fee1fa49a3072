"""Runs a query in Spark and its SQL in DuckDB and compares the rows, whatever their order."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "is_integer"):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, query, sql, sf_dir):
    """Up to five rows that only one side has, as text; empty if the sides agree."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    got = con.sql(sql)
    theirs = rows_of(got.columns, got.fetchall())
    if sorted(df.columns) != sorted(got.columns):
        return [f"columns {sorted(df.columns)} and {sorted(got.columns)}"]
    if len(ours) != len(theirs):
        return [f"{len(ours)} and {len(theirs)} rows", *map(str, ours[:2]), *map(str, theirs[:2])]
    return [f"{a} | {b}" for a, b in zip(ours, theirs) if a != b][:5]
