"""Compares a registered query with its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def shown(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, str)):
        return str(v)
    return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) else str(v)


def rows(columns, values) -> list:
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return [tuple(order), *sorted(tuple(shown(r[k]) for k in at) for r in values)]


def same(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    rel = views(sf_dir).sql(sql)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(rel.columns), rel.fetchall())
