"""Runs a registered query and its SQL and compares names, types and values."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("QUILLON_DATA", "/root/testdata")


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    con.execute(sql)
    return [c[0] for c in con.description], con.fetchall()


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value + 0.0:.6g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(int(value)) if not isinstance(value, str) and hasattr(value, "__int__") else str(value)


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    names, want = oracle_rows(sql, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    place = [names.index(n) for n in order]
    a = sorted(tuple(_plain(v) for v in r) for r in df.select(*order).collect())
    b = sorted(tuple(_plain(r[i]) for i in place) for r in want)
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows of {order}; {only_a} against {only_b}"
