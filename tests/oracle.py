"""Comparison of a Spark result with DuckDB's, order aside."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con.execute(sql).fetchdf()


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
        return "NULL"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if hasattr(v, "__float__") and not isinstance(v, str):
        return f"{float(v):.6f}"
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(_value(v) for v in r) for r in frame[cols].itertuples(index=False))


def assert_same(df, sql, sf_dir):
    ours, theirs = df.toPandas(), duck(sql, sf_dir)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
