"""Queries over streams, each with the SQL that gives the rows of the tables once all files are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.plans.usage_queries import QUERIES as USAGE
from logloom.sources.shared import shared_dir
from logloom.sources.views import message_view, on_few_routes, requests_of, table, with_views
from logloom.streaming.growing import current_lines, growing_lines
from logloom.streaming.ordered_fold import follow_in_order
from logloom.streaming.usage import file_stream, follow_buckets, followed_buckets


def stream_usage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    # A pattern: a stream's plain path has to be a folder, and the table may be a single file.
    events = file_stream(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema)
    follow_buckets(on_few_routes(requests_of(events)), f"{at}/buckets", f"{at}/state").awaitTermination()
    return followed_buckets(spark, f"{at}/buckets")


def stream_ordered_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages dealt to files without regard to their order, then followed in order, one file a batch."""
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    messages = message_view(spark, sf_dir).select("file", "seq", "cat", "tokens")
    messages.repartition(3).write.parquet(f"{at}/messages")
    stream = file_stream(spark, f"{at}/messages", messages.schema, files_per_batch=1)
    follow_in_order(stream, wait_ms=None).writeStream.option("checkpointLocation", f"{at}/state").format("parquet").option("path", f"{at}/folded").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/folded").selectExpr("CAST(file AS BIGINT) AS file", "seq", "cat", "turn", "step", "tokens", "system_seq", "late")


def stream_growing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as JSON lines in two lots of files, each followed by a run of its own that goes on where the one before ended."""
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    messages = message_view(spark, sf_dir).select("file", "seq", "cat")
    for lot in (0, 1):
        messages.where(f"seq % 2 = {lot}").select(F.to_json(F.struct("file", "seq", "cat")).alias("value")).repartition(3).write.mode("append").text(f"{at}/lines")
        keep = lambda rows, batch, lot=lot: rows.withColumn("batch", F.lit(2 * batch + lot)).write.mode("append").parquet(f"{at}/read")
        growing_lines(spark, f"{at}/lines", "part-*.txt").writeStream.option("checkpointLocation", f"{at}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    lines = current_lines(spark.read.parquet(f"{at}/read"))
    return lines.select(F.from_json("value", "file bigint, seq bigint, cat string").alias("r")).select("r.*")


QUERIES = {
    "stream_growing_lines": (stream_growing_lines, with_views("v_msg") + " SELECT file, seq, cat FROM v_msg"),
    "stream_usage_buckets": (stream_usage_buckets, USAGE["usage_buckets"][1]),
    "stream_ordered_fold": (
        stream_ordered_fold,
        with_views("v_turn") + """ SELECT file, seq, cat, turn, step, CAST(sum(tokens) OVER w AS BIGINT) AS tokens, max(CASE WHEN cat = 'system' THEN seq END) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS system_seq, false AS late
FROM v_turn WINDOW w AS (PARTITION BY file ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
    ),
}
