"""Registry prices over a registry of all ways to match and to fail, against the query's SQL on the same rows."""

from __future__ import annotations

import duckdb

from logloom.operators.registry_prices import registry_matches
from logloom.plans.record_queries import QUERIES

REGISTRY = [("anthropic", "claude-a-1"), ("reseller", "claude-a-1"), ("openai", "gpt-x"), ("openai", "GPT-X"), ("openai", "team-gpt-y"), ("other", "big-gpt-y"), ("deepseek", "deepseek-r"), ("reseller", "deepseek-r"), ("lone", "solo-m"), ("one", "twin"), ("two", "twin"), ("moonshotai", "Kimi-K")]
PAIRS = [(p, m) for p in ("anthropic", "openai", "deepseek-official", "kimi-coding", "nobody", "reseller") for m in ("claude-a-1", "claude-a-1[1m]", "CLAUDE-A-1", "gpt-x", "Gpt-x", "gpt-y", "deepseek-r", "r", "m", "twin", "kimi-k", "none")]


def test_registry_matches_equal_the_sql(spark):
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
    rest = QUERIES["cost_registry_match"][1].split("\na AS (", 1)[1]
    want = duckdb.sql(f"WITH g(branch, name) AS (VALUES {values(REGISTRY)}), p(provider, model) AS (VALUES {values(PAIRS)}), a AS ({rest}").fetchall()
    got = registry_matches(spark.createDataFrame(PAIRS, "provider string, model string"), spark.createDataFrame(REGISTRY, "branch string, name string"))
    assert set(map(tuple, got.select("provider", "model", "entry_provider", "entry").collect())) == set(want) and any(w[3] for w in want)
