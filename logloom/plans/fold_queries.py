"""Queries over the surface of a context, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators import context as C
from logloom.operators import surface as S
from logloom.sources.views import table, with_views


def _fold_view(spark, sf_dir) -> DataFrame:
    """Each user's events as a context in blocks of ten places.

    Place 0 replaces the system prompt of the block before, 4 the span of 1 and 2; 6 names 3 and 5,
    which 7 removes; 8 names a span whose start is gone; 9 replaces the span from 4 to 7.
    """
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint").alias("seq"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"))
    m, seq = F.col("seq") % 10, F.col("seq")
    kind = F.when(m == 0, "system").when(m != 6, "node").when(F.floor(seq / 10) % 2 == 0, "compaction").otherwise("prune")
    cat = F.when(m == 0, "system").when(m.isin(3, 8), "assistant").when(m != 6, "user")
    first = F.when((m == 0) & (seq > 0), seq - 10).when(m == 4, seq - 3).when(m == 7, seq - 2).when(m == 8, seq - 7).when(m == 9, seq - 5)
    last = F.when((m == 0) & (seq > 0), seq - 10).when(m == 4, seq - 2).when(m == 7, seq - 2).when(m == 8, seq - 1).when(m == 9, seq - 2)
    return e.select("file", "seq", kind.alias("kind"), cat.alias("cat"), "tokens", first.alias("first"), last.alias("last"), F.when(m == 6, F.array(seq - 3, seq - 1)).alias("shadowed"))


_FOLD = with_views("ev") + """, b AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, k AS tokens FROM ev),
a AS (SELECT *, seq % 10 AS m, max(seq) OVER (PARTITION BY file) AS top FROM b),
c AS (SELECT *, seq + CASE m WHEN 0 THEN 10 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 2 WHEN 7 THEN 2 END AS til FROM a WHERE m <> 6),
n AS (SELECT file, seq, CASE WHEN m = 0 THEN 'system' WHEN m IN (3, 8) THEN 'assistant' ELSE 'user' END AS cat, tokens, seq - CASE m WHEN 4 THEN 3 WHEN 9 THEN 8 ELSE 0 END AS pos, CASE WHEN til <= top THEN til END AS gone FROM c)"""


def _compactions(spark, sf_dir):
    events = _fold_view(spark, sf_dir)
    return S.compactions(events, S.surface_nodes(events))


QUERIES = {
    "context_surface_nodes": (lambda s, d: S.surface_nodes(_fold_view(s, d)), _FOLD + " SELECT * FROM n"),
    "context_surface_at_step": (
        lambda s, d: C.alive_at_steps(S.surface_nodes(_fold_view(s, d))),
        _FOLD + ", p AS (SELECT a.file, a.seq, count(b.seq) AS alive, CAST(coalesce(sum(b.tokens), 0) AS BIGINT) AS tokens FROM n a LEFT JOIN n b ON b.file = a.file AND b.seq < a.seq AND (b.gone IS NULL OR b.gone > a.seq) WHERE a.cat = 'assistant' GROUP BY 1, 2) SELECT * FROM p",
    ),
    "context_compactions": (
        _compactions,
        _FOLD + """, w AS (SELECT *, lag(tokens) OVER f + lag(tokens, 3) OVER f - lead(tokens) OVER f AS freed FROM a WINDOW f AS (PARTITION BY file ORDER BY seq))
SELECT file, seq, CASE WHEN seq // 10 % 2 = 0 THEN 'compaction' ELSE 'prune' END AS kind, CASE WHEN seq // 10 % 2 = 0 THEN 2 END AS n, CASE WHEN seq < top THEN greatest(0, freed) ELSE tokens END AS tokens FROM w WHERE m = 6""",
    ),
}
