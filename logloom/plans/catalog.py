"""All queries of this library outside the llm folder, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("usage_queries", "session_queries", "context_queries", "cost_queries", "record_queries", "decoder_queries", "node_queries", "fold_queries", "forest_queries", "index_queries", "producer_queries", "stream_queries")


def _all() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for m in MODULES:
        out |= importlib.import_module(f"logloom.plans.{m}").QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
