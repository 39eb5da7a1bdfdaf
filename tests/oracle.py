"""Run a query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            c.sql(f"CREATE VIEW {t} AS FROM '{path}'")
    return c


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "\0null"
        if isinstance(v, float):
            return f"f{v:.9g}"
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return str([plain(x) for x in v])
        return f"{type(v).__name__[:4]}:{v}" if not hasattr(v, "item") else plain(v.item())

    columns = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


def differences(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    got = query(spark, sf_dir)
    mine = pd.DataFrame([r.asDict() for r in got.collect()], columns=got.columns)
    c = connect(sf_dir)
    r = c.sql(sql)
    want = pd.DataFrame(r.fetchall(), columns=r.columns)
    if sorted(mine.columns) != sorted(want.columns):
        return f"{name}: columns {sorted(mine.columns)} and {sorted(want.columns)}"
    a, b = rows(mine), rows(want)
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a, only_b = [x for x in a if x not in in_b][:3], [x for x in b if x not in in_a][:3]
        return f"{name}: {len(a)} and {len(b)} rows; only Spark {only_a}; only SQL {only_b}"
    types = {k.lower(): str(t) for k, t in zip(r.columns, r.types, strict=True)}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [(k, t, types[k.lower()]) for k, t in got.dtypes if kinds.get(t, types[k.lower()]) != types[k.lower()]]
    return f"{name}: types {odd}" if odd else ""
