"""Compare registered queries with their SQL, as the driver does: row count, columns and values, in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return x


def canonical(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, c: duckdb.DuckDBPyConnection) -> str:
    """An empty string, or what differs."""
    want = c.execute(sql)
    names = [x[0] for x in want.description]
    want, got = canonical(names, want.fetchall()), canonical(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(names)} / {sorted(df.columns)}"
    if len(want) != len(got):
        return f"rows {len(want)} / {len(got)}"
    bad = [(w, g) for w, g in zip(want, got) if w != g]
    return f"{len(bad)} of {len(want)} rows, such as {bad[0]}" if bad else ""
