"""Runs a query and its SQL twin and compares them as unordered rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

DATA = os.environ.get("TEST_DATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        at = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}'")
    return con


def plain(value):
    """A hashable form in which the same values of either engine are equal."""
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return tuple(plain(x) for x in value)
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows_of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    con.execute(sql)
    names = [d[0] for d in con.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in con.fetchall())


def rows_of_spark(df) -> tuple[list[str], Counter]:
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    return [df.columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in df.collect())
