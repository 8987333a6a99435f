"""Test data and the comparison of a query with its SQL."""

from __future__ import annotations

import decimal

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def lcg(n: int, seed: int) -> np.ndarray:
    """Reproducible float32 numbers in [-1, 1)."""
    out, s = np.empty(n, dtype=np.float32), seed
    for i in range(n):
        s = (s * 1664525 + 1013904223) % 2**32
        out[i] = np.float32(s >> 8) / np.float32(8388608) - np.float32(1)
    return out


def vectors(rows: int, dim: int, seed: int) -> list[list[float]]:
    return lcg(rows * dim, seed).reshape(rows, dim).astype(float).tolist()


def _text(v) -> str:
    if isinstance(v, decimal.Decimal):
        return str(int(v)) if v == int(v) else repr(float(v))
    return repr(v) if isinstance(v, float) else str(v)


def rows_by_name(columns, rows) -> tuple:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_text(r[i]) for i in order) for r in rows)


def sql_rows(sql: str, sf_dir: str) -> tuple:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = c.sql(sql)
    return rows_by_name(got.columns, got.fetchall())
