"""Queries that decode logs rebuilt, as their producers write them, from conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.sources.transcripts import every_request, message_requests, rollout_requests, tree_requests
from logloom.sources.views import message_view, with_views

_COLUMNS = ("session", "request", "kind", "model", "provider", "t_ms", "measured", "input", "output", "cache_read", "cache_write", "reasoning")


def _lines(spark, sf_dir, *records: Column) -> DataFrame:
    """Columns file, at, value: the JSON lines that each message of a conversation leaves."""
    m = message_view(spark, sf_dir).withColumns({"time": F.concat(F.lit("2024-01-01T00:"), F.lpad((F.col("seq") % 60).cast("string"), 2, "0"), F.lit(":00.250Z")), "length": F.length("text").cast("bigint")})
    each = m.select(F.concat(F.lit("/logs/c"), F.col("file").cast("string"), F.lit(".jsonl")).alias("file"), "seq", F.posexplode(F.array(*records)).alias("n", "value")).where(F.col("value").isNotNull())
    return each.select("file", F.struct("seq", "n").alias("at"), "value")


def _when(condition: Column, **fields: Column) -> Column:
    return F.when(condition, F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])))


def _message_log(spark, sf_dir) -> DataFrame:
    said = F.col("cat") == "assistant"
    usage = F.when(F.col("seq") % 5 != 4, F.struct(F.col("tokens").alias("input_tokens"), F.col("length").alias("output_tokens"), F.when(F.col("seq") % 2 == 0, F.lit(7)).alias("cache_read_input_tokens")))
    part = lambda u: _when(said, type=F.lit("assistant"), timestamp=F.col("time"), requestId=F.concat(F.lit("r"), F.col("seq").cast("string")), message=F.struct(F.concat(F.lit("m"), (F.col("file") % 3).cast("string")).alias("model"), u.alias("usage")))
    early = F.when(F.col("seq") % 5 != 4, F.struct(F.col("tokens").alias("input_tokens"), F.lit(1).cast("bigint").alias("output_tokens"), F.lit(None).cast("int").alias("cache_read_input_tokens")))
    return _lines(spark, sf_dir, F.lit("no json"), part(early), _when(F.col("cat") == "user", type=F.lit("user"), message=F.struct(F.col("text").alias("content"))), part(usage))


def _rollout(spark, sf_dir) -> DataFrame:
    said, first = F.col("cat") == "assistant", F.col("seq") == 0
    usage = F.struct((F.col("tokens") + 3).alias("input_tokens"), F.lit(3).cast("bigint").alias("cached_input_tokens"), F.col("length").alias("output_tokens"), (F.col("length") % 5).alias("reasoning_output_tokens"))
    return _lines(
        spark, sf_dir, _when(first, type=F.lit("session_meta"), payload=F.struct(F.col("file").cast("string").alias("id"), F.concat(F.lit("p"), (F.col("file") % 2).cast("string")).alias("model_provider"))),
        _when(F.col("cat") == "user", type=F.lit("turn_context"), payload=F.struct(F.concat(F.lit("m"), (F.col("seq") % 4).cast("string")).alias("model"))),
        _when(said, type=F.lit("event_msg"), timestamp=F.col("time"), payload=F.struct(F.lit("token_count").alias("type"), F.struct(usage.alias("last_token_usage")).alias("info"))),
        _when(said & (F.col("file") % 3 == 0), type=F.lit("token_usage_record"), timestamp=F.col("time"), payload=F.struct(F.col("seq").cast("string").alias("response_id"), usage.alias("usage"))), F.lit("[1]"),
    )


def _tree(spark, sf_dir) -> DataFrame:
    usage = F.when(F.col("seq") % 5 != 4, F.struct(F.col("tokens").alias("input"), F.col("length").alias("output"), F.lit(2).cast("bigint").alias("cacheWrite")))
    message = F.struct(F.col("cat").alias("role"), F.lit("m").alias("model"), F.lit("p").alias("provider"), usage.alias("usage"))
    record = _when(F.lit(True), type=F.lit("message"), id=F.concat(F.lit("i"), F.col("seq").cast("string")), timestamp=F.col("time"), message=message)
    return _lines(spark, sf_dir, record, F.when(F.col("seq") % 2 == 0, record))


_M = with_views("v_msg") + ", m AS (SELECT 'c' || file AS session, file, seq, cat, tokens, length(text) AS length, 1704067200250 + (seq % 60) * 60000 AS t_ms FROM v_msg)"
_NULL = "CAST(NULL AS BIGINT)"
_MESSAGE_SQL = f"SELECT session, 'r' || seq AS request, 'claude' AS kind, 'm' || file % 3 AS model, 'anthropic' AS provider, t_ms, seq % 5 <> 4 AS measured, CASE WHEN seq % 5 <> 4 THEN tokens END AS input, CASE WHEN seq % 5 <> 4 THEN length END AS output, CASE WHEN seq % 5 <> 4 AND seq % 2 = 0 THEN CAST(7 AS BIGINT) END AS cache_read, {_NULL} AS cache_write, {_NULL} AS reasoning FROM m WHERE cat = 'assistant'"
_ROLLOUT_SQL = f"""SELECT session, CAST(row_number() OVER (PARTITION BY file ORDER BY seq) AS VARCHAR) AS request, 'codex' AS kind, 'm' || (SELECT max(u.seq) FROM m u WHERE u.file = m.file AND u.seq < m.seq AND u.cat = 'user') % 4 AS model,
 CASE WHEN EXISTS (SELECT 1 FROM m z WHERE z.file = m.file AND z.seq = 0) THEN 'p' || file % 2 END AS provider, t_ms, true AS measured, tokens AS input, length AS output, CAST(3 AS BIGINT) AS cache_read, {_NULL} AS cache_write, length % 5 AS reasoning FROM m WHERE cat = 'assistant'"""
_TREE_SQL = f"SELECT session, 'i' || seq AS request, 'pi' AS kind, 'm' AS model, 'p' AS provider, t_ms, seq % 5 <> 4 AS measured, CASE WHEN seq % 5 <> 4 THEN tokens END AS input, CASE WHEN seq % 5 <> 4 THEN length END AS output, {_NULL} AS cache_read, CASE WHEN seq % 5 <> 4 THEN CAST(2 AS BIGINT) END AS cache_write, {_NULL} AS reasoning FROM m WHERE cat = 'assistant'"

QUERIES = {
    "decode_message_log": (lambda s, d: message_requests(_message_log(s, d)).select(*_COLUMNS), f"{_M} {_MESSAGE_SQL}"),
    "decode_rollout_log": (lambda s, d: rollout_requests(_rollout(s, d)).select(*_COLUMNS), f"{_M} {_ROLLOUT_SQL}"),
    "decode_tree_log": (lambda s, d: tree_requests(_tree(s, d)).select(*_COLUMNS), f"{_M} {_TREE_SQL}"),
    "decode_every_log": (
        lambda s, d: every_request({"claude": _message_log(s, d), "codex": _rollout(s, d), "pi": _tree(s, d)}).groupBy("kind", "model", "provider").agg(F.count(F.lit(1)).alias("requests"), F.count_if("measured").alias("measured"), F.sum("input").alias("input"), F.sum("output").alias("output")),
        f"{_M}, e AS ({_MESSAGE_SQL} UNION ALL {_ROLLOUT_SQL} UNION ALL {_TREE_SQL}) SELECT kind, model, provider, count(*) AS requests, count(*) FILTER (measured) AS measured, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output FROM e GROUP BY 1, 2, 3",
    ),
}
