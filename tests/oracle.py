"""Comparing a query with its SQL on the same tables."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connection(sf_dir: str = DATA):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(query, sql, spark, sf_dir: str = DATA):
    df = query(spark, sf_dir)
    found = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(found.columns, found.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
