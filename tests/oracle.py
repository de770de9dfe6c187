"""Run a query and its SQL and compare: columns by name, rows in any order, numbers to 9 digits."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return c


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return None if isinstance(x, float) and math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, bool) or x is None or isinstance(x, (str, bytes)):
        return x
    if isinstance(x, int):
        return float(f"{float(x):.9g}")
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in x.asDict().items()))
    return tuple(map(plain, x))


def differences(df, sql: str, c) -> str:
    got_names = df.columns
    found = c.execute(sql)
    want_names = [d[0] for d in found.description]
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(set(got_names) ^ set(want_names))}"
    order = sorted(got_names)
    want = Counter(tuple(plain(r[want_names.index(n)]) for n in order) for r in found.fetchall())
    got = Counter(tuple(plain(r[n]) for n in order) for r in df.collect())
    if got == want:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:2]}; only in SQL {list((want - got).items())[:2]}; columns {order}"
