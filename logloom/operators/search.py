"""Substring search over deduplicated texts: candidates, exact counts, snippets and grouping.

Frames of documents have session, file, line and text. Letters A-Z match in either case, others
only themselves. A needle of fewer than three characters finds nothing.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.calls import rendered_call

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct trigrams of a needle that are looked up at most.
MAX_TRIGRAMS = 64
MAX_CHARS = 16_384


def folded(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def needle_of(query: str) -> str:
    """The query without blanks around it, A-Z in lower case; empty if too short to search for."""
    n = query.strip().translate(str.maketrans(UPPER, LOWER))
    return n if len(n) >= 3 else ""


def trigrams(needle: str) -> list[str]:
    return list(dict.fromkeys(needle[k : k + 3] for k in range(len(needle) - 2)))[:MAX_TRIGRAMS]


def text_dedup(docs: DataFrame) -> DataFrame:
    """One row per distinct text: its key, where it occurs first, how often, and its characters.

    Only hashes are shuffled, not texts.
    """
    return docs.groupBy(F.substring(F.sha1("text"), 1, 16).alias("text_key")).agg(
        F.min("line").alias("first_line"), F.count(F.lit(1)).alias("occurrences"), F.max(F.length("text")).cast("bigint").alias("n_chars")
    )


def scrubbed(c: Column) -> Column:
    """Text as it is indexed: the first run of encoded data, heads of data addresses and control characters give way to blanks; of bounded length.

    Later runs of encoded data stay, as in the logs' own index.
    """
    plain = F.regexp_replace(c, "(?s)^(.*?)[A-Za-z0-9+/]{256,}={0,2}", "$1 ")
    plain = F.regexp_replace(F.regexp_replace(plain, "(?i)data:[a-z0-9.+/-]*;base64,", " "), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    return F.left(F.regexp_replace(plain, r"^\s+|\s+$", ""), F.lit(MAX_CHARS))


def search_documents(nodes: DataFrame) -> DataFrame:
    """Columns file, at, n, role, text: what of a log is searched for, from nodes of any producer (sources.producers).

    A prompt is human, an answer assistant, a call tool (its name and the arguments that say what it
    does), reasoning other. Results, injected input and summaries are not indexed, nor what is
    empty once scrubbed.
    """
    role = F.when(F.col("kind") == "user", "human").when(F.col("kind") == "assistant", "assistant").when(F.col("kind") == "tool-call", "tool").when(F.col("kind") == "reasoning", "other")
    said = F.when(F.col("kind") == "tool-call", rendered_call(F.coalesce("name", F.lit("tool")), F.col("args"))).otherwise(F.col("text"))
    return nodes.select("file", "at", "n", role.alias("role"), scrubbed(said).alias("text")).where("role IS NOT NULL AND text <> ''")


def candidates(docs: DataFrame, query: str, cap: int = 4096) -> DataFrame:
    """Lines whose text holds every trigram of the needle, in order, and whether there were more.

    All trigrams are looked for in one pass over a text, so nothing is exploded or shuffled but
    what is found.
    """
    needle = needle_of(query)
    if not needle:
        return docs.where(F.lit(False)).select("line", F.lit(False).alias("truncated"))
    text = folded(F.col("text"))
    found = docs.where(reduce(and_, (F.contains(text, F.lit(t)) for t in trigrams(needle)))).select("line")
    page = found.orderBy("line").limit(cap + 1)
    more = page.agg((F.count(F.lit(1)) > cap).alias("truncated"))
    return page.crossJoin(F.broadcast(more)).orderBy("line").limit(cap)


def hits(docs: DataFrame, query: str) -> DataFrame:
    """Every document that holds the needle, and how often without overlap."""
    needle = needle_of(query)
    text = folded(F.col("text"))
    found = docs.where(F.contains(text, F.lit(needle))) if needle else docs.where(F.lit(False))
    count = (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / max(1, len(needle))
    return found.select("session", "file", "line", "text", count.cast("bigint").alias("matches"))


def ranked_hits(docs: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The documents of most matches, equal ones by line."""
    return hits(docs, query).orderBy(F.desc("matches"), "line").limit(max(1, min(200, limit))).select("session", "file", "line", "matches")


def grouped_hits(docs: DataFrame, query: str, limit: int = 50, each: int = 5) -> DataFrame:
    """The page of hits by session: at most a few of each, the session's total over all hits, and its best place."""
    page = ranked_hits(docs, query, limit)
    of = Window.partitionBy("session")
    first = page.withColumn("place", F.row_number().over(of.orderBy(F.desc("matches"), "line")).cast("bigint")).withColumn("best", F.max("matches").over(of))
    totals = hits(docs, query).groupBy("session").agg(F.sum("matches").alias("total"))
    return first.where(F.col("place") <= each).join(totals, "session").select("session", "line", "matches", "place", "best", "total")


def snippets(docs: DataFrame, query: str, around: int = 64) -> DataFrame:
    """Of each hit the text around the first match, and where in it the match begins."""
    needle = needle_of(query)
    at = F.instr(folded(F.col("text")), needle)
    start = F.greatest(F.lit(1), at - around)
    return hits(docs, query).select("line", F.substring(F.col("text"), start, at - start + len(needle) + around).alias("snippet"), (at - start).cast("bigint").alias("match_at"))


def orphans(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Text keys that no document holds any more."""
    return texts.join(docs.select(F.substring(F.sha1("text"), 1, 16).alias("text_key")).distinct(), "text_key", "left_anti").select("text_key", "occurrences")


def within_kind(docs: DataFrame, query: str, files: list[str]) -> DataFrame:
    """Text keys of hits that occur in one of the files."""
    key = F.substring(F.sha1("text"), 1, 16).alias("text_key")
    inside = docs.where(F.col("file").isin(files)).select(key)
    return hits(docs, query).select(key, "matches").distinct().join(inside, "text_key", "left_semi")


def with_all_terms(messages: DataFrame, query: str) -> DataFrame:
    """Messages that hold every term of the query, in the role's name or in the text."""
    hay = F.lower(F.concat_ws(" ", "cat", "text"))
    return messages.where(reduce(and_, (F.contains(hay, F.lit(t)) for t in query.lower().split()), F.lit(True))).select("file", "seq", "cat")
