"""Comparing a query with its SQL in DuckDB."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df):
    c = sorted(df.columns)
    return c, sorted((tuple(plain(v) for v in r) for r in df[c].astype(object).itertuples(index=False, name=None)), key=repr)


def same(spark_df, sql, con):
    (c1, r1), (c2, r2) = rows(spark_df.toPandas()), rows(con.sql(sql).df())
    assert c1 == c2
    assert len(r1) == len(r2)
    for a, b in zip(r1, r2, strict=True):
        assert a == b
