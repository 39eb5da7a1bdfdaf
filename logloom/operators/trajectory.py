"""Order and structure of a session: pairing, turns, merged replay, timelines and ledger rows.

Every window is kept within a file (one session's log), so files spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, 0)


def _file() -> WindowSpec:
    return Window.partitionBy("file").orderBy("seq")


def pair_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls beside their results: a call alone still runs, a result alone has lost its call."""
    c = calls.select("call_id", F.col("seq").alias("call_seq"), F.col("t_ms").alias("call_ms"), "tool")
    r = results.select("call_id", F.col("seq").alias("result_seq"), F.col("t_ms").alias("result_ms"), "is_error")
    state = F.when(F.col("result_seq").isNull(), "running").when(F.col("call_seq").isNull(), "orphan").when(F.col("is_error"), "failed").otherwise("done")
    return c.join(r, "call_id", "full_outer").select("call_id", "call_seq", "result_seq", "tool", state.alias("state"), (F.col("result_ms") - F.col("call_ms")).alias("duration_ms"))


def turn_assignment(turns: DataFrame) -> DataFrame:
    """Each message with its turn, its step, and the next assistant's message."""
    after = _file().rowsBetween(1, Window.unboundedFollowing)
    return turns.select("file", "seq", "cat", "turn", "step", F.min(F.when(F.col("cat") == "assistant", F.col("seq"))).over(after).alias("next_assistant"))


def merge_key(log: DataFrame) -> DataFrame:
    """Records with the time at which a merge of all files by time lets them out.

    Missing times are those of the record before, at a file's start those of the first timed
    one. No record leaves before the ones ahead of it in its file, so its key is the greatest
    time so far; sorting by (merge_ms, file, seq) is the merged order.
    """
    whole = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = log.withColumn("t", F.coalesce(F.last("t_ms", True).over(_file().rowsBetween(*_SO_FAR)), F.first("t_ms", True).over(whole), F.lit(-(1 << 62))))
    return filled.select("file", "seq", "t_ms", F.max("t").over(_file().rowsBetween(*_SO_FAR)).alias("merge_ms"))


def replay(log: DataFrame) -> DataFrame:
    """All files' records in merged order, by a distributed sort."""
    return merge_key(log).orderBy("merge_ms", "file", "seq")


def timeline_sequence(spans: DataFrame) -> DataFrame:
    """Spans at their place in the file and at their distance in time from its first start."""
    first = F.min("start").over(Window.partitionBy("file"))
    return spans.select("file", "seq", "lane", F.row_number().over(_file()).cast("bigint").alias("place"), (F.col("start") - first).alias("offset_ms"), (F.col("end") - F.col("start")).alias("duration_ms"))


def timeline_compressed(spans: DataFrame) -> DataFrame:
    """Spans with the idle time before them taken out."""
    w = Window.partitionBy("file").orderBy("start", "end", "seq")
    gap = F.greatest(F.lit(0), F.coalesce(F.col("start") - F.max("end").over(w.rowsBetween(*_BEFORE)), F.lit(0)))
    return spans.withColumn("gap", gap).withColumn("removed", F.sum("gap").over(w.rowsBetween(*_SO_FAR))).select("file", "seq", (F.col("start") - F.col("removed")).alias("start"), (F.col("end") - F.col("removed")).alias("end"), "removed")


def line_targets(log: DataFrame, reach: int = 4096) -> DataFrame:
    """For each line the nearest target at or before it, within reach."""
    return log.select("file", "seq", F.last(F.when(F.col("k") % 4 == 0, F.col("seq")), True).over(_file().rowsBetween(-reach, 0)).alias("target"))


def number_requests(messages: DataFrame) -> DataFrame:
    """Requests numbered in their file, with the tokens up to each."""
    own = messages.where(F.col("cat") == "assistant")
    return own.select("file", "seq", F.row_number().over(_file()).cast("bigint").alias("number"), F.sum("tokens").over(_file().rowsBetween(*_SO_FAR)).alias("running_tokens"))


def step_groups(turns: DataFrame) -> DataFrame:
    """Each step's extent, tokens, and how many messages of each kind it has."""
    kinds = turns.groupBy("file", "turn", "step", "cat").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b"), F.sum("tokens").alias("tokens"))
    said = F.array_join(F.sort_array(F.collect_list(F.concat("cat", F.lit(":"), F.col("n").cast("string")))), ",")
    return kinds.groupBy("file", "turn", "step").agg(F.min("a").alias("first_seq"), F.max("b").alias("last_seq"), F.sum("tokens").alias("tokens"), said.alias("kinds"))


def ledger(turns: DataFrame) -> DataFrame:
    """Rows of a ledger: a heading before each turn's messages, in one dense order per file."""
    heads = turns.groupBy("file", "turn").agg(F.min("seq").alias("seq")).select("file", "turn", "seq", F.lit("turn").alias("kind"), F.lit(0).alias("level"))
    rows = heads.unionByName(turns.select("file", "turn", "seq", F.col("cat").alias("kind"), F.lit(1).alias("level")))
    return rows.select("file", "turn", "seq", "kind", F.row_number().over(Window.partitionBy("file").orderBy("seq", "level")).cast("bigint").alias("place"))


def turn_rail(turns: DataFrame, chars: int = 40) -> DataFrame:
    """Each turn's last message in brief, and how many before it are folded away."""
    return turns.groupBy("file", "turn").agg(F.max_by(F.struct("cat", F.left("text", F.lit(chars)).alias("preview")), "seq").alias("last"), (F.count(F.lit(1)) - 1).alias("folded")).select("file", "turn", "last.cat", "last.preview", "folded")


def turn_usage(turns: DataFrame) -> DataFrame:
    """Tokens of a turn: the latest sample that speaks for the whole turn, else the sum of all."""
    whole = F.col("seq") % 5 == 0
    return turns.groupBy("file", "turn").agg(F.coalesce(F.max_by(F.when(whole, F.col("tokens")), F.when(whole, F.col("seq"))), F.sum("tokens")).alias("tokens"))
