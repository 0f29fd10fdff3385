"""Rows of a query and of its SQL in DuckDB, in one comparable form."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return round(float(x), 9)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return x


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in got), key=repr)


def duck(sql: str, sf_dir: str = SF):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return sorted(names), rows(names, out.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, df.collect())
