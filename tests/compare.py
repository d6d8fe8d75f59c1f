"""Spark's rows against DuckDB's, as sets of printed values."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v) -> str:
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return str([shown(x) for x in v])
    return str(v)


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(shown(r[i]) for i in order) for r in rows)


def connection(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def differing(df, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    with connection(sf_dir) as con:
        other = con.sql(sql)
        names, expected = other.columns, other.fetchall()
    got = df.collect()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, expected)
    return "" if a == b else f"only in Spark {list((a - b).items())[:3]}, only in DuckDB {list((b - a).items())[:3]}"
