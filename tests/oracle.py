"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}" if x else "0"
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def rows(columns, data) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def differences(df, con, sql: str) -> list[str]:
    found = con.execute(sql)
    names, want = [c[0] for c in found.description], found.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, want)
    if a == b:
        return []
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return [f"{len(a)} and {len(b)} rows; only in the query {only_a}; only in SQL {only_b}"]
