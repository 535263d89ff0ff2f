"""Compare a Spark result with DuckDB's for the same query, whatever the row order."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return value


def normal(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    values = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(values, key=repr)


def differences(df, sql: str, con) -> list[str]:
    if len(set(df.columns)) < len(df.columns):
        return [f"repeated column names {sorted({c for c in df.columns if df.columns.count(c) > 1})}"]
    names, mine = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    wanted_names, wanted = normal([d[0] for d in cursor.description], cursor.fetchall())
    if names != wanted_names:
        return [f"columns {sorted(set(names) ^ set(wanted_names))}"]
    out = []
    if len(mine) != len(wanted):
        out.append(f"rows {len(mine)} instead of {len(wanted)}")
    extra = sorted(set(mine) - set(wanted), key=repr)
    missing = sorted(set(wanted) - set(mine), key=repr)
    for a, b in list(zip(extra, missing))[:3]:
        out.append("; ".join(f"{n}: {x!r} not {y!r}" for n, x, y in zip(names, a, b) if x != y))
    if extra or missing:
        out.append(f"{len(extra)} extra, {len(missing)} missing: {(extra or missing)[0]}")
    return out
