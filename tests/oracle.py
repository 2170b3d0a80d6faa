"""Compares a query with its SQL: columns by name, rows in any order, doubles to six digits."""

from __future__ import annotations

from decimal import Decimal

import duckdb

from foliant.session import TABLES


def cell(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(cell(r[c]) for c in names) for r in df.collect()), key=repr)


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(cell(r[i]) for i in order) for r in got.fetchall()), key=repr)
