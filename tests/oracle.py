"""Compares a query with its SQL on the same tables."""

import datetime as dt
import math

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (int, np.integer)):
        return f"{float(v):.6g}" if abs(v) < 100_000 else str(int(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def rows_of(df) -> list[str]:
    names = sorted(df.columns)
    return sorted("|".join(plain(r[n]) for n in names) for r in (x.asDict(True) for x in df.collect()))


def rows_of_sql(c, sql: str) -> tuple[list[str], list[str]]:
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    made = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    return sorted(names), sorted("|".join(plain(r[n]) for n in sorted(names)) for r in made)
