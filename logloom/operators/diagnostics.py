"""What went wrong in a session: repeated failures, troubled turns, slow tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.calls import argument_key

#: Codes of errors that a user has caused.
USER_CODES = ("turn_aborted", "thread_rolled_back")


def repeated_failures(log: DataFrame, least: int = 3) -> DataFrame:
    """Runs of failures of one call, the same tool with the same arguments, without a success or a boundary between them.

    log has file, seq, boundary, is_error, tool, args and code. Segments are counted by the
    boundaries before a record, runs by the successes of the same call before it in its segment.
    A run has recovered if a success ends it, and is interleaved if results of other calls lie
    between its failures. codes are its failures' codes, sorted. place orders the runs of a file:
    those that have not recovered first, then by failures, then by their first record.
    """
    log = log.withColumn("key", argument_key(F.col("args")))
    call = ("file", "segment", "tool", "key")
    by_file = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    by_key = Window.partitionBy(*call).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        log.withColumn("segment", F.count_if("boundary").over(by_file)).withColumn("place", F.count_if(~F.col("boundary")).over(by_file)).where(~F.col("boundary"))
        .withColumn("run", F.coalesce(F.count_if(~F.col("is_error")).over(by_key), F.lit(0)))
    )
    in_run = Window.partitionBy(*call, "run", "is_error").orderBy("seq")
    gap = F.col("place") - F.lag("place").over(in_run)
    runs = (
        numbered.withColumn("gap", gap).groupBy(*call, "run")
        .agg(
            F.count_if("is_error").alias("failures"), F.min(F.when(F.col("is_error"), F.col("seq"))).alias("first_seq"), F.min(F.when(~F.col("is_error"), F.col("seq"))).alias("recovered_by"),
            F.coalesce(F.max(F.when(F.col("is_error"), F.col("gap") > 1)), F.lit(False)).alias("interleaved"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_error"), F.col("code")))), ",").alias("codes"),
        )
        .where(F.col("failures") >= least)
    )
    order = Window.partitionBy("file").orderBy(F.col("recovered_by").isNotNull(), F.desc("failures"), "first_seq")
    return runs.withColumn("place", F.row_number().over(order)).select("file", "place", "tool", "key", "first_seq", "failures", "recovered_by", "interleaved", "codes")


def model_trouble(nodes: DataFrame) -> DataFrame:
    """Steps with two retries, any error or a stop at the output limit, and what failed last: a retry, else an error.

    nodes has file, turn, step, seq, kind, state and code. Of retries only the scheduled ones
    count, and errors that a user has caused do not.
    """
    retry, error, limit = ((F.col("kind") == k) for k in ("model-retry", "turn-error", "turn-max-tokens"))
    counted = nodes.where((retry & (F.col("state") == "scheduled")) | (error & ~F.coalesce(F.col("code").isin(*USER_CODES), F.lit(False))) | limit)
    last = lambda kind: F.max_by(F.when(kind, F.coalesce("code", F.lit("error"))), F.when(kind, F.col("seq")))
    return (
        counted.groupBy("file", "turn", "step")
        .agg(F.min("seq").alias("seq"), F.count_if(retry).alias("retries"), F.count_if(error).alias("errors"), F.count_if(limit).alias("limits"), F.coalesce(last(retry), last(error)).alias("last_code"))
        .where((F.col("retries") >= 2) | (F.col("errors") > 0) | (F.col("limits") > 0))
    )


def slowest_tool(spans: DataFrame) -> DataFrame:
    """Of each file the slowest call that was not issued together with another, and its tool's median."""
    alone = F.count(F.lit(1)).over(Window.partitionBy("file", "start")) == 1
    own = spans.withColumn("alone", alone).where("alone").withColumn("ms", F.col("end") - F.col("start"))
    per = own.groupBy("file", "lane").agg(F.max_by(F.struct("ms", "seq"), F.struct("ms", -F.col("seq"))).alias("top"), F.percentile("ms", 0.5).alias("median_ms"))
    best = per.groupBy("file").agg(F.max_by(F.struct("lane", "top", "median_ms"), F.struct("top.ms", -F.col("top.seq"))).alias("b"))
    return best.select("file", F.col("b.lane").alias("tool"), F.col("b.top.seq").alias("seq"), F.col("b.top.ms").alias("ms"), F.col("b.median_ms").alias("median_ms"))


def argument_summary(props: Column, keys: tuple[str, ...] = ("path", "query", "k"), chars: int = 160) -> Column:
    """The first of some arguments that a call has, its blanks collapsed, cut to a length."""
    first = F.coalesce(*[F.get_json_object(props, f"$.{k}") for k in keys])
    return F.left(F.trim(F.regexp_replace(first, r"\s+", " ")), F.lit(chars))
