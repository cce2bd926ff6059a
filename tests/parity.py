"""Compare registered queries with their SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def connection(sf_dir: str):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def differences(df, sql: str, c) -> str:
    """What differs, or an empty text."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    out = c.execute(sql)
    want = rows([d[0] for d in out.description], out.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        return f"{len(got[1])} and {len(want[1])} rows; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return ""
