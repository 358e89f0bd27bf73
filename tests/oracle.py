"""Runs a query's SQL with DuckDB over the test tables and compares rows."""

from __future__ import annotations

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def oracle_rows(sf: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def assert_same(df, sf: str, sql: str) -> None:
    columns, rows = oracle_rows(sf, sql)
    order = sorted(columns)
    assert sorted(df.columns) == order
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rows), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want
