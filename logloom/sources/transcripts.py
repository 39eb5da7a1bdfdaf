"""Transcripts in JSON lines, as agents append them, read as requests for the usage operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The fields of a message-log record that usage is read from.
_RECORD = (
    "type string, timestamp string, requestId string, uuid string, isApiErrorMessage boolean, message struct<id: string, model: string, "
    "usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint, output_tokens_details: struct<thinking_tokens: bigint>>>"
)


def read_lines(spark: SparkSession, root: str, name: str = "*.jsonl") -> DataFrame:
    """Columns file, at, value: the lines of all files of that name in root and below; `at` orders a file's lines.

    Files are split and read in parallel: a line's place is where its split begins and its number within it.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number")).alias("at"), "value")


def up_to(lines: DataFrame, end: int) -> DataFrame:
    """The lines of each file that end, with their line feeds, within its first `end` bytes."""
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("end", F.sum(F.octet_length("value") + 1).over(w)).where(F.col("end") <= end).drop("end")


def message_requests(lines: DataFrame, kind: str = "claude", provider: str = "anthropic") -> DataFrame:
    """One row per model request of a log that writes a response's blocks as sibling records.

    Records of one request id (else the message's id, else the record's) are one request: the last
    usage and the last model hold, and the first time. Input counts are without caches. A request
    without usage is unmeasured and its counters are null; a missing counter of a usage is null,
    but input and output are zero. Lines that are no JSON objects, or of other types, are skipped.
    """
    r = lines.select("file", "at", F.from_json("value", _RECORD).alias("r")).where(F.col("r.type") == "assistant").select("file", "at", "r.*")
    ids = F.coalesce("requestId", "message.id", "uuid", F.lit("request"))
    usage = F.col("message.usage")
    one = (
        r.groupBy("file", ids.alias("request"))
        .agg(
            F.max_by(F.col("message.model"), F.when(F.col("message.model").isNotNull(), F.col("at"))).alias("model"), F.max_by(usage, F.when(usage.isNotNull(), F.col("at"))).alias("u"),
            F.min(F.unix_millis(F.try_to_timestamp("timestamp"))).alias("t_ms"),
        )
    )
    measured = F.col("u").isNotNull()
    zero = lambda c: F.when(measured, F.coalesce(F.col(f"u.{c}"), F.lit(0)))
    return one.select(
        F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1).alias("session"), "request", F.lit(kind).alias("kind"), "model", F.lit(provider).alias("provider"), "t_ms", measured.alias("measured"),
        zero("input_tokens").alias("input"), zero("output_tokens").alias("output"), F.col("u.cache_read_input_tokens").alias("cache_read"), F.col("u.cache_creation_input_tokens").alias("cache_write"),
        F.col("u.output_tokens_details.thinking_tokens").alias("reasoning"),
    )


#: The fields of a rollout record that usage is read from.
_ROLLOUT = "type string, timestamp string, payload struct<type: string, id: string, model: string, model_provider: string, turn_id: string, response_id: string, info: struct<last_token_usage: {u}>, usage: {u}>".format(
    u="struct<input_tokens: bigint, cached_input_tokens: bigint, output_tokens: bigint, reasoning_output_tokens: bigint, total_tokens: bigint>"
)


def rollout_requests(lines: DataFrame, kind: str = "codex") -> DataFrame:
    """One row per model request of a log that states usage in records of its own.

    Usage comes in token_usage_record, or in token_count events where a file has none of those.
    The model is that of the last turn_context before, the provider that of the first header.
    Input counts are without the cached part. Lines that are no JSON objects are skipped.
    """
    r = lines.select("file", "at", F.from_json("value", _ROLLOUT).alias("r")).where(F.col("r.type").isNotNull()).select("file", "at", "r.type", "r.timestamp", "r.payload.model", "r.payload.model_provider", "r.payload.info", "r.payload.usage", F.col("r.payload.type").alias("event"))
    so_far = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("file")
    record, count = F.col("type") == "token_usage_record", (F.col("type") == "event_msg") & (F.col("event") == "token_count")
    known = (
        r.withColumn("now_model", F.last(F.when(F.col("type") == "turn_context", F.col("model")), True).over(so_far)).withColumn("by", F.first(F.when(F.col("type") == "session_meta", F.col("model_provider")), True).over(so_far))
        .withColumn("stated", F.coalesce(F.max(record).over(whole), F.lit(False))).where(record | (count & ~F.col("stated"))).withColumn("u", F.when(record, F.col("usage")).otherwise(F.col("info.last_token_usage")))
        .where(F.col("u").isNotNull()).withColumn("request", F.row_number().over(Window.partitionBy("file").orderBy("at")))
    )
    cached = F.coalesce("u.cached_input_tokens", F.lit(0))
    return known.select(
        F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1).alias("session"), F.col("request").cast("string").alias("request"), F.lit(kind).alias("kind"), F.col("now_model").alias("model"), F.col("by").alias("provider"), F.unix_millis(F.try_to_timestamp("timestamp")).alias("t_ms"),
        F.lit(True).alias("measured"), F.greatest(F.coalesce("u.input_tokens", F.lit(0)) - cached, F.lit(0)).alias("input"), F.coalesce("u.output_tokens", F.lit(0)).alias("output"), F.col("u.cached_input_tokens").alias("cache_read"), F.lit(None).cast("bigint").alias("cache_write"), F.col("u.reasoning_output_tokens").alias("reasoning"),
    )


#: The fields of a tree log's record that usage is read from.
_TREE = "type string, id string, parentId string, timestamp string, message struct<role: string, model: string, provider: string, stopReason: string, usage: struct<input: bigint, output: bigint, cacheRead: bigint, cacheWrite: bigint, reasoning: bigint, totalTokens: bigint>>"


def tree_requests(lines: DataFrame, kind: str = "pi") -> DataFrame:
    """One row per assistant message of a log whose records name their parents; a repeated id counts once, its last record.

    A message without usage is unmeasured and its counters are null.
    """
    r = lines.select("file", "at", F.from_json("value", _TREE).alias("r")).where((F.col("r.type") == "message") & (F.col("r.message.role") == "assistant")).select("file", "at", "r.*")
    last = r.groupBy("file", "id").agg(F.max_by(F.struct("message", "timestamp"), "at").alias("m")).select("file", "id", "m.*")
    u, measured = F.col("message.usage"), F.col("message.usage").isNotNull()
    zero = lambda c: F.when(measured, F.coalesce(u[c], F.lit(0)))
    return last.select(
        F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1).alias("session"), F.col("id").alias("request"), F.lit(kind).alias("kind"), "message.model", "message.provider", F.unix_millis(F.try_to_timestamp("timestamp")).alias("t_ms"), measured.alias("measured"),
        zero("input").alias("input"), zero("output").alias("output"), u["cacheRead"].alias("cache_read"), u["cacheWrite"].alias("cache_write"), u["reasoning"].alias("reasoning"),
    )


def every_request(logs: dict[str, DataFrame]) -> DataFrame:
    """The requests of logs of several producers, by the decoder of each."""
    decoders = {"claude": message_requests, "codex": rollout_requests, "pi": tree_requests}
    made = [decoders[k](lines) for k, lines in sorted(logs.items())]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out
