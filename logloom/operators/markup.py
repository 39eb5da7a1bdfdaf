"""Agents that a result's text names: in the lines of its head, or in balanced markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tags and lines that results are written with.
WRAPPER = "agent_swarm_result"
TAG = r"(\n?)<(/?)subagent\b([^>\n]*)>"
ATTRIBUTE = r'(\w+)="([^"]*)"'
LINE = r"(?m)^[ \t]*{}:[ \t]*({})[ \t]*$"
COMPLETED, FAILED, STOPPED = ("completed",), ("failed", "error"), ("aborted", "killed", "stopped", "cancelled", "canceled")

_MENTION = "struct<agent_id: string, description: string, agent_type: string, status: string>"


def _status(word: Column) -> Column:
    return F.when(word.isin(*COMPLETED), "completed").when(word.isin(*FAILED), "failed").when(word.isin(*STOPPED), "stopped")


def _attribute(said: Column, name: str) -> Column:
    """The value of an attribute in a tag, the last if it is there twice, with entities resolved; null if it is not there."""
    keys, values = F.regexp_extract_all(said, F.lit(ATTRIBUTE), 1), F.regexp_extract_all(said, F.lit(ATTRIBUTE), 2)
    own = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda a: a["k"] == name)
    value = F.try_element_at(own, F.lit(-1))["v"]
    for entity, character in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(character))
    return value


def swarm_mentions(text: Column) -> Column:
    """The members of a swarm's result: closed elements at the top of the wrapper that begin a line and have an id.

    Depth runs over the tags in order, inside the row: no tag is exploded or moved. A text without
    the wrapper's end, or whose tags do not balance, names nobody.
    """
    body = F.regexp_extract(text, rf"(?s)^\s*<{WRAPPER}>(.*)</{WRAPPER}>\s*$", 1)
    body = F.concat(F.lit("\n"), body)
    parts = [F.regexp_extract_all(body, F.lit(TAG), k) for k in (1, 2, 3)]
    tags = F.arrays_zip(parts[0].alias("line"), parts[1].alias("close"), parts[2].alias("said"))
    none = F.lit(None).cast(_MENTION)
    begun = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("bad"), none.alias("open"), F.array().cast(f"array<{_MENTION}>").alias("out"))

    def step(acc: Column, tag: Column) -> Column:
        close, top = tag["close"] == "/", acc["depth"] == 0
        agent = _attribute(tag["said"], "agent_id")
        mention = F.struct(agent.alias("agent_id"), _attribute(tag["said"], "item").alias("description"), F.lit(None).cast("string").alias("agent_type"), _status(_attribute(tag["said"], "outcome")).alias("status")).cast(_MENTION)
        named = ~close & top & (tag["line"] != "") & (F.coalesce(agent, F.lit("")) != "")
        ends = close & (acc["depth"] == 1)
        return F.struct(
            F.when(close, acc["depth"] - 1).otherwise(acc["depth"] + 1).alias("depth"), (acc["bad"] | (close & top)).alias("bad"), F.when(named, mention).when(ends | (~close & top), none).otherwise(acc["open"]).alias("open"),
            F.when(ends & acc["open"].isNotNull(), F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"]).alias("out"),
        )

    sound = lambda acc: F.when(~acc["bad"] & (acc["depth"] == 0), acc["out"]).otherwise(F.array().cast(f"array<{_MENTION}>"))
    return F.aggregate(tags, begun, step, sound)


def head_mention(text: Column) -> Column:
    """The agent that the lines before the first blank line name, as an array of one or none."""
    head = F.try_element_at(F.split(text, r"\n[ \t]*\n", 2), F.lit(1))
    value = lambda name, kind: F.nullif(F.regexp_extract(head, LINE.format(name, kind), 1), F.lit(""))
    agent = value("agent_id", r"\S+")
    own = F.struct(agent.alias("agent_id"), F.lit(None).cast("string").alias("description"), value("actual_subagent_type", r"\S+").alias("agent_type"), _status(value("status", r"\w+")).alias("status")).cast(_MENTION)
    return F.when(agent.isNotNull(), F.array(own)).otherwise(F.array().cast(f"array<{_MENTION}>"))


def agent_mentions(results: DataFrame, text: str = "text") -> DataFrame:
    """All columns of results and, a row for each agent that the text names, place, agent_id, description, agent_type, status.

    A text that begins with the wrapper is markup; in others only the head is read, as the body is the agent's own. A null text names nobody.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    found = F.when(said.rlike(rf"^\s*<{WRAPPER}>"), swarm_mentions(said)).otherwise(head_mention(said))
    return results.select("*", F.posexplode(found).alias("place", "m")).select(*[F.col(f"`{c}`") for c in results.columns], "place", "m.*")
