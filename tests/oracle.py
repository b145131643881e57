"""Run a registered query and its DuckDB oracle and compare the sorted rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _same(a, b) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, float) and isinstance(b, float):
        if math.isnan(a) and math.isnan(b):
            return True
    return a == b


def difference(columns, rows, duck_columns, duck_rows) -> str | None:
    """None if both row sets are equal, else a short description."""
    if sorted(columns) != sorted(duck_columns):
        return f"columns {sorted(columns)} != {sorted(duck_columns)}"
    order = sorted(columns)
    left = sorted(([r[columns.index(c)] for c in order] for r in rows), key=_key)
    right = sorted(([r[duck_columns.index(c)] for c in order] for r in duck_rows), key=_key)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    bad = [(a, b) for a, b in zip(left, right) if not all(_same(x, y) for x, y in zip(a, b))]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, e.g. {order}: {bad[0][0]} != {bad[0][1]}"
    return None
