"""Clocks of messages that carry none, from the turns and items around them; never backwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def message_clocks(messages: DataFrame, sessions: DataFrame, turns: DataFrame, items: DataFrame) -> DataFrame:
    """Columns file, seq, t_ms: a time for each message, not before that of the message before it.

    messages: file, seq, kind, request_id, call_ids (array). sessions: file, created_at, updated_at, last_time (null: nothing
    was timed yet), one row a file. turns: file, turn (number), request_id, prompt_time. items: file, turn, item
    (number), kind (thinking, text or tool), call_id, start, end.

    A human's message has its turn's prompt time, and a second one of the same request the turn's first start
    if that is not before it. Its turn is that of its request, if not before the turn reached so far. An
    assistant's message has the first start of its calls, or without calls that of the next thought or text after the last
    calls before it; a tool's message has the end of its call; system and injection messages have the
    session's creation. Others, and what finds no time, have the time before. Where no turn has any time,
    the first message has the session's creation and all others its last update. Items are
    taken to come in the order of messages.
    """
    order = Window.partitionBy("file").orderBy("seq")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    human, assistant = F.col("kind") == "human", F.col("kind") == "assistant"
    requests = turns.where("request_id <> ''").groupBy("file", "request_id").agg(F.min("turn").alias("own_turn"))
    m = messages.join(requests, ["file", "request_id"], "left")
    reached = F.max(F.when(human, F.col("own_turn")))
    m = m.withColumns({"turn": reached.over(so_far), "turn_before": reached.over(before), "asked_before": F.last(F.when(human, F.struct("request_id"))  , True).over(before)})
    m = m.withColumn("again", F.coalesce((F.col("asked_before.request_id") == F.col("request_id")) & (F.col("request_id") != "") & F.col("turn_before").isNotNull(), F.lit(False)))
    lost = human & ~F.col("again") & (F.coalesce("request_id", F.lit("")) != "") & (F.col("own_turn").isNull() | (F.col("own_turn") < F.coalesce("turn_before", F.lit(-1))))
    facts = items.where("start IS NOT NULL").groupBy("file", "turn").agg(F.min_by("start", "item").alias("first_start"))
    prompts = turns.select("file", "turn", "prompt_time").dropDuplicates(["file", "turn"])
    m = m.withColumn("lost", F.coalesce(lost, F.lit(False))).join(prompts, ["file", "turn"], "left").join(facts, ["file", "turn"], "left")

    calls = items.where("kind = 'tool' AND call_id IS NOT NULL").groupBy("file", "turn", "call_id").agg(F.min("item").alias("item"), F.min_by("start", "item").alias("start"), F.min_by("end", "item").alias("end"))
    asked = m.where(F.col("kind").isin("assistant", "tool")).select("file", "seq", "turn", F.explode(F.array_distinct("call_ids")).alias("call_id"))
    met = asked.join(calls, ["file", "turn", "call_id"]).groupBy("file", "seq").agg(F.min("start").alias("call_start"), F.min_by("end", "item").alias("call_end"), F.max("item").alias("last_item"))
    m = m.join(met, ["file", "seq"], "left")
    with_calls = F.size(F.coalesce("call_ids", F.array())) > 0
    # An assistant's message without calls takes the next thought or text that none has taken since the last calls.
    in_turn = Window.partitionBy("file", "turn").orderBy("seq")
    m = m.withColumn("after_item", F.coalesce(F.last(F.when(assistant & with_calls, F.col("last_item")), True).over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    said = Window.partitionBy("file", "turn", "after_item").orderBy("seq")
    m = m.withColumn("place", F.when(assistant & ~with_calls, F.count_if(assistant & ~with_calls).over(said.rowsBetween(Window.unboundedPreceding, 0))))
    spoken = items.where(F.col("kind").isin("thinking", "text"))
    spoken = spoken.select("file", "turn", "start", "item", F.row_number().over(Window.partitionBy("file", "turn").orderBy("item")).cast("bigint").alias("rank"))
    anchors = m.where("place IS NOT NULL").select("file", "turn", "after_item").distinct()
    marks = spoken.select("file", "turn", "item", F.col("rank").alias("passed"), F.lit(None).cast("bigint").alias("after_item")).unionByName(anchors.select("file", "turn", F.col("after_item").cast(items.schema["item"].dataType).alias("item"), F.lit(None).cast("bigint").alias("passed"), F.col("after_item").cast("bigint").alias("after_item")))
    up_to = Window.partitionBy("file", "turn").orderBy("item", F.col("after_item").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    passed = marks.withColumn("passed", F.coalesce(F.max("passed").over(up_to), F.lit(0))).where("after_item IS NOT NULL").select("file", "turn", "after_item", "passed")
    m = m.join(passed, ["file", "turn", "after_item"], "left").withColumn("rank", F.col("passed") + F.col("place"))
    m = m.join(spoken.select("file", "turn", "rank", F.col("start").alias("spoken_at")), ["file", "turn", "rank"], "left")

    usable = turns.where("prompt_time IS NOT NULL").select("file").union(items.where("start IS NOT NULL OR end IS NOT NULL").select("file")).distinct().withColumn("usable", F.lit(True))
    m = m.join(sessions, "file").join(usable, "file", "left")
    again = F.when(F.col("first_start").isNotNull() & (F.col("prompt_time").isNull() | (F.col("first_start") >= F.col("prompt_time"))), F.col("first_start")).otherwise(F.col("prompt_time"))
    raw = (
        F.when(F.col("usable").isNull(), F.when(F.row_number().over(order) == 1, F.col("created_at")).otherwise(F.greatest("created_at", "updated_at")))
        .when(F.col("kind").isin("system", "injection"), F.col("created_at")).when(human & F.col("lost"), None).when(human, F.when(F.col("again"), again).otherwise(F.col("prompt_time")))
        .when(assistant & with_calls, F.col("call_start")).when(assistant, F.col("spoken_at")).when(F.col("kind") == "tool", F.col("call_end"))
    )
    floor = F.coalesce(F.greatest(F.max("raw").over(so_far), "last_time"), F.col("created_at"))
    # Before the first time that is known the session's creation stands, and nothing falls below it then.
    timed = m.withColumn("raw", raw).withColumn("raw", F.when(F.col("raw").isNull() & F.col("last_time").isNull() & F.max("raw").over(before).isNull(), F.col("created_at")).otherwise(F.col("raw")))
    return timed.select("file", "seq", floor.cast("bigint").alias("t_ms"))
