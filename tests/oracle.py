"""Compares a Spark result with a DuckDB result, order-insensitive."""

import os
from collections import Counter

import duckdb

DATA = "/root/testdata/sf0.001"


def connected():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in table)


def assert_same(spark, query, sql):
    made = query(spark, DATA)
    got = rows(made.columns, map(tuple, made.collect()))
    found = connected().execute(sql)
    assert got == rows([d[0] for d in found.description], found.fetchall())
