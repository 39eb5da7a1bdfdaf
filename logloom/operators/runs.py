"""The state of runs that a log starts and hears of: calls of subagents, their receipts, results and notices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The words that notices use for the states a run ends in; any other says that it has failed.
COMPLETED = ("completed",)
STOPPED = ("killed", "stopped", "cancelled", "canceled")


def run_states(events: DataFrame) -> DataFrame:
    """Columns file, call_id, status, ended_at, agent_id, model, description: one row for each call.

    events: file, call_id, seq, kind, t_ms, is_error, said (a notice's word), agent_id, model,
    description. kind: `call` launches a run; `receipt` says that it runs on; `result` reports its
    end; `notice` says how it ended. A repeated call starts anew, and what came before a call says
    nothing. The last notice holds over results and receipts; without one the first result; without
    that a receipt makes it running. All of it is least, greatest or any of a group's rows, so rows
    are combined before they move and a call of many events needs no task of its own.
    """
    known = events.where(F.col("file").isNotNull() & F.col("call_id").isNotNull() & F.col("seq").isNotNull())
    began = known.where("kind = 'call'").groupBy("file", "call_id").agg(F.max("seq").alias("began"))
    own = known.join(began, ["file", "call_id"]).where("seq >= began")
    notice, result = F.col("kind") == "notice", F.col("kind") == "result"
    ended = F.when(F.col("said").isin(*STOPPED), "stopped").when(F.col("said").isin(*COMPLETED), "completed").otherwise("failed")
    last = F.max_by(F.struct(ended.alias("status"), F.col("t_ms").alias("at")), F.when(notice, F.col("seq")))
    first = F.min_by(F.struct(F.when(F.coalesce("is_error", F.lit(False)), "failed").otherwise("completed").alias("status"), F.col("t_ms").alias("at")), F.when(result, F.col("seq")))
    earliest = lambda c, when: F.min_by(F.col(c), F.when(F.col(c).isNotNull() & when, F.col("seq"))).alias(c)
    facts = own.groupBy("file", "call_id").agg(last.alias("last"), first.alias("first"), F.coalesce(F.bool_or(F.col("kind") == "receipt"), F.lit(False)).alias("runs"), earliest("agent_id", F.col("kind") != "call"), earliest("model", ~notice), earliest("description", ~notice))
    status = F.coalesce(F.col("last.status"), F.col("first.status"), F.when(F.col("runs"), "running").otherwise("launching"))
    at = F.when(F.col("last").isNotNull(), F.col("last.at")).otherwise(F.col("first.at"))
    return facts.select("file", "call_id", status.alias("status"), at.alias("ended_at"), "agent_id", "model", "description")
