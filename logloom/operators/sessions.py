"""Session listings: rollups, keyset pages, facets and durations over requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Milliseconds since the last write within which a session counts as live.
LIVE_MS = 120_000


def listing(requests: DataFrame, now_ms: int) -> DataFrame:
    """One row per session: first and last time, requests, kinds of children, whether it is live."""
    return requests.groupBy("session").agg(
        F.min("t_ms").alias("started_at"), F.max("t_ms").alias("updated_at"), F.count(F.lit(1)).alias("requests"), F.count_distinct("kind").alias("children")
    ).withColumn("live", F.lit(now_ms) - F.col("updated_at") < LIVE_MS)


def keyset_page(sessions: DataFrame, after: tuple[int, int] | None = None, limit: int = 100) -> DataFrame:
    """The page after a cursor (updated_at, session), newest first, and whether more follow."""
    rest = sessions
    if after:
        rest = sessions.where((F.col("updated_at") < after[0]) | ((F.col("updated_at") == after[0]) & (F.col("session") > after[1])))
    size = max(1, min(500, limit))
    page = rest.orderBy(F.desc("updated_at"), "session").limit(size + 1)
    more = page.agg((F.count(F.lit(1)) > size).alias("has_more"))
    return page.crossJoin(F.broadcast(more)).orderBy(F.desc("updated_at"), "session").limit(size)


def facet_counts(docs: DataFrame, query: str, kinds: list[str]) -> DataFrame:
    """Counts by kind of what matches the query, and by project of what also is of the kinds.

    Each side is counted where it is read; both come from one scan's columns.
    """
    found = docs.where(F.contains(F.lower("session"), F.lit(query.strip().lower())))
    by_kind = found.groupBy(F.col("file").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("kind").alias("facet"), "key", "n")
    by_project = found.where(F.col("file").isin(kinds)).groupBy(F.col("session").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("project").alias("facet"), "key", "n")
    return by_kind.unionByName(by_project)


def duration(requests: DataFrame) -> DataFrame:
    """From the first to the last request; null where that is nothing."""
    span = F.max("t_ms") - F.min("t_ms")
    return requests.groupBy("session").agg(F.when(span > 0, span).alias("duration_ms"))


def retained(requests: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Sessions written to within so many days; 0 days keep all."""
    last = requests.groupBy("session").agg(F.max("t_ms").alias("updated_at"))
    return last.where(F.col("updated_at") >= now_ms - days * 86_400_000) if days else last
