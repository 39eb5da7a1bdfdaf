"""Which rows of a transcript kept in changing tables are final: the lines before the first that may still change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_KEY = ["file", "message"]


def settled_lines(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Columns file, message, level, part, at: the lines that may be given out, in order of at, message, level, part.

    messages: file, message (id), at, role, completed and error (facts that end it), seen (whether an
    earlier look found it last, or found what it waits for). parts: file, message, part (id), type,
    ended (whether its own end is there; null where the type has no end), compaction (whether it is one).
    level 0 is the message's header, 1 a part of an assistant's message, 2 its end.

    Lines are given out up to the first open message, itself as far as it is settled. An assistant's part
    is settled with its message's end, with a later assistant's message, or with its own end; one that
    is not holds back those after it. A user's header waits until a later message is there, or until it
    has parts and was seen before; if it is a compaction, until its summary, the next assistant's
    message, has failed, was followed by another, or has ended and was seen. Messages without file or id
    and parts without message are left out. What is given out stays given out as rows are added and
    completed, so a later call continues an earlier one.
    """
    order = Window.partitionBy("file").orderBy("at", "message")
    after, before = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    assistant = F.coalesce(F.col("role") == "assistant", F.lit(False))
    of_user = F.coalesce(F.col("role") == "user", F.lit(False))
    per = parts.where(F.col("part").isNotNull()).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_parts"), F.bool_or(F.coalesce("compaction", F.lit(False))).alias("compacts"))
    m = messages.where(F.col("file").isNotNull() & F.col("message").isNotNull()).join(per, _KEY, "left").withColumns({"n_parts": F.coalesce("n_parts", F.lit(0)), "compacts": F.coalesce("compacts", F.lit(False)), "ended": F.coalesce(F.col("completed"), F.lit(False)) | F.coalesce(F.col("error"), F.lit(False))})
    m = m.withColumns({"later": F.count(F.lit(1)).over(after) > 0, "later_assistant": F.coalesce(F.bool_or(assistant).over(after), F.lit(False))})
    facts = F.struct("ended", F.coalesce("error", F.lit(False)).alias("failed"), "later_assistant")
    m = m.withColumn("summary", F.first(F.when(assistant, facts), True).over(after))
    seen = F.coalesce("seen", F.lit(False))
    compacted = F.coalesce(F.col("summary.failed") | F.col("summary.later_assistant") | (F.col("summary.ended") & seen), F.lit(False))
    m = m.withColumn("header", F.when(of_user & F.col("compacts"), compacted).when(of_user, F.col("later") | ((F.col("n_parts") > 0) & seen)).otherwise(True))
    closed = F.when(of_user, F.col("header")).when(assistant, F.col("ended") | F.col("later_assistant")).otherwise(F.col("n_parts") == 0)
    m = m.withColumn("reached", F.coalesce(F.bool_and(closed).over(before), F.lit(True))).where("reached AND header")

    own = F.when(F.col("type").isin("text", "reasoning", "tool"), F.coalesce(F.col("p_ended"), F.col("type") == "text")).otherwise(True)
    held = parts.where(F.col("part").isNotNull()).select(*_KEY, "part", "type", F.col("ended").alias("p_ended"))
    inside = held.join(m.where(assistant).select(*_KEY, "at", "ended", "later_assistant"), _KEY).withColumn("settled", F.col("ended") | F.col("later_assistant") | own)
    up_to = Window.partitionBy(*_KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    out = inside.withColumn("so_far", F.bool_and("settled").over(up_to)).where("so_far").select(*_KEY, F.lit(1).alias("level"), "part", "at")
    no_part = F.lit(None).cast(parts.schema["part"].dataType).alias("part")
    header = m.select(*_KEY, F.lit(0).alias("level"), no_part, "at")
    end = m.where(assistant & F.col("ended")).select(*_KEY, F.lit(2).alias("level"), no_part, "at")
    return header.unionByName(out).unionByName(end)


def newly_settled(lines: DataFrame, before: DataFrame) -> DataFrame:
    """The settled lines that an earlier call had not given out."""
    given = before.select(F.col("file").alias("f"), F.col("message").alias("m"), F.col("level").alias("l"), F.col("part").alias("p"))
    return lines.join(given, (F.col("file") == F.col("f")) & (F.col("message") == F.col("m")) & (F.col("level") == F.col("l")) & F.col("part").eqNullSafe(F.col("p")), "left_anti")
