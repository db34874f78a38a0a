"""Queries against their SQL on the same tables: rows as multisets, columns by name."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def value(x):
    if x is None:
        return (0, 0)
    if isinstance(x, bool):
        return (1, int(x))
    if isinstance(x, (int, float)):
        return (1, "nan" if isinstance(x, float) and math.isnan(x) else float(f"{float(x):.7g}"))
    return (2, str(x))


def difference(df, con, sql: str) -> str:
    """Empty if both results are equal, else what differs first."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    right_rows = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    left = sorted(tuple(value(r[c]) for c in order) for r in df.collect())
    right = sorted(tuple(value(r[names.index(c)]) for c in order) for r in right_rows)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}; {order}; {left[:1]} {right[:1]}"
    for a, b in zip(left, right):
        if a != b and any(x != y and not (x[0] == y[0] == 1 and isinstance(x[1], float) and isinstance(y[1], float) and abs(x[1] - y[1]) <= 2e-6 * max(1, abs(x[1]))) for x, y in zip(a, b)):
            return f"{order}: {a} against {b}"
    return ""
