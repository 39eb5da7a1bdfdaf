"""What fills a session's context window: composition, intervals, as-of lookups and trends.

Frames of messages have file, seq, cat and tokens. Messages of the assistant are the requests;
those of the system are headers. As-of joins and interval joins are written as windows over
each file's rows, so no pair of rows is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CATEGORIES = ("user", "assistant", "system")


def _by(*more: str):
    return Window.partitionBy("file", *more).orderBy("seq")


def _before(*more: str):
    return _by(*more).rowsBetween(Window.unboundedPreceding, -1)


def _so_far(*more: str):
    return _by(*more).rowsBetween(Window.unboundedPreceding, 0)


def _after(*more: str):
    return _by(*more).rowsBetween(1, Window.unboundedFollowing)


def _is(cat: str) -> Column:
    return F.col("cat") == cat


def categories(m: DataFrame) -> DataFrame:
    return m.groupBy("file", "cat").agg(F.count(F.lit(1)).alias("nodes"), F.sum("tokens").alias("tokens"))


def timeline(m: DataFrame) -> DataFrame:
    """At each request, the tokens of each category before it; its own answer is not yet there."""
    sums = [F.coalesce(F.sum(F.when(_is(c), F.col("tokens"))).over(_before()), F.lit(0)).alias(c) for c in CATEGORIES]
    return m.select("file", "seq", "cat", *sums).where(_is("assistant")).select("file", "seq", *CATEGORIES, (F.col("user") + F.col("assistant") + F.col("system")).alias("total"))


def composition(m: DataFrame) -> DataFrame:
    """Each category's tokens over all files, and its share."""
    sums = m.groupBy("cat").agg(F.sum("tokens").alias("tokens"))
    every = sums.agg(F.sum("tokens").alias("every"))
    return sums.crossJoin(F.broadcast(every)).select("cat", "tokens", F.round(F.col("tokens") / F.col("every"), 6).alias("share"))


def counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("file").agg(F.count_distinct("turn").alias("turns"), F.count_if(_is("assistant")).alias("steps"), F.count_if(_is("system")).alias("injects"))


def usage(requests: DataFrame) -> DataFrame:
    """Sums of a session's measured input; null where nothing was measured. The hit rate is cut, not rounded."""
    own = F.col("measured")
    parts = requests.groupBy("session").agg(
        F.count_if(own).alias("measured"), F.sum(F.when(own, F.col("cache_read"))).alias("cached"), F.sum(F.when(own, F.greatest(F.lit(0), F.col("input") - F.col("cache_read") - F.col("cache_write")))).alias("uncached")
    )
    whole = F.col("cached") + F.col("uncached")
    return parts.withColumn("hit_percent", F.when(whole > 0, F.floor(F.col("cached") * 10000 / whole) / 100))


def headline(m: DataFrame, window: int = 2000) -> DataFrame:
    """Tokens in the window now: those at the last request and what has come since; percent at most 100."""
    anchored = m.withColumn("last", F.max(F.when(_is("assistant"), F.col("seq"))).over(Window.partitionBy("file")))
    sums = anchored.groupBy("file").agg(F.coalesce(F.sum(F.when(F.col("seq") < F.col("last"), F.col("tokens"))), F.lit(0)).alias("prompt"), F.sum("tokens").alias("current"))
    return sums.withColumn("percent", F.least(F.lit(100), F.floor(F.col("current") * 100 / window)))


def derived_system(m: DataFrame) -> DataFrame:
    """What a request's prompt holds beyond what is priced, carried to the messages after it."""
    priced = F.coalesce(F.sum("tokens").over(_before()), F.lit(0))
    own = F.when(_is("assistant") & (F.col("seq") % 3 == 0), F.greatest(F.lit(0), F.col("tokens") * 4 - priced))
    return m.withColumn("own", own).select("file", "seq", F.last("own", True).over(_so_far()).alias("derived"))


def replaced_at(m: DataFrame) -> DataFrame:
    """Messages with `gone`, the place of the next header where a header is replaced by it, else null."""
    return m.withColumn("gone", F.when(_is("system"), F.lead("seq").over(_by("cat"))))


def surface_at_step(m: DataFrame) -> DataFrame:
    """As alive_at_steps, of messages that only headers replace."""
    return alive_at_steps(replaced_at(m))


def alive_at_steps(nodes: DataFrame) -> DataFrame:
    """At each request, how many messages of a lower place are not yet gone, and their tokens.

    A message adds its tokens at its place and takes them back where it goes, so a running sum
    gives what an interval join would.
    """
    steps = nodes.select("file", "seq", F.lit(0).alias("order"), F.lit(1).alias("n"), "tokens", _is("assistant").alias("asks"))
    gone = nodes.where(F.col("gone").isNotNull()).select("file", F.col("gone").alias("seq"), F.lit(-1).alias("order"), F.lit(-1).alias("n"), (-F.col("tokens")).alias("tokens"), F.lit(False).alias("asks"))
    w = Window.partitionBy("file").orderBy("seq", "order").rowsBetween(Window.unboundedPreceding, -1)
    alive = steps.unionByName(gone).select("file", "seq", "asks", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("alive"), F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("tokens"))
    return alive.where("asks").drop("asks")


def surface_window(m: DataFrame, newest: int = 3) -> DataFrame:
    """The newest messages of each file and all headers, and the highest place that was dropped."""
    ranked = m.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("seq"))))
    kept = (F.col("rank") <= newest) | _is("system")
    return ranked.withColumn("kept", kept).withColumn("floor", F.max(F.when(~F.col("kept"), F.col("seq"))).over(Window.partitionBy("file"))).where("kept").select("file", "seq", "cat", "floor")


def header_asof(m: DataFrame) -> DataFrame:
    """The header in force at each request: the last one strictly before it."""
    header = F.last(F.when(_is("system"), F.struct("seq", "tokens")), True).over(_before())
    return m.select("file", "seq", "cat", header.alias("h")).where(_is("assistant")).select("file", "seq", F.col("h.seq").alias("header_seq"), F.col("h.tokens").alias("header_tokens"))


def attributed_events(m: DataFrame) -> DataFrame:
    """Each header's next request, after it, and previous one, at or before it."""
    request = F.when(_is("assistant"), F.col("seq"))
    return m.select("file", "seq", "cat", F.min(request).over(_after()).alias("next_request"), F.max(request).over(_so_far()).alias("previous_request")).where(_is("system")).drop("cat")


def trend_markers(m: DataFrame) -> DataFrame:
    """The request at which each header shows, the first at or after it; of several the first header."""
    request = F.min(F.when(_is("assistant"), F.col("seq"))).over(_by().rowsBetween(0, Window.unboundedFollowing))
    marked = m.select("file", "seq", "cat", request.alias("request")).where(_is("system") & F.col("request").isNotNull())
    return marked.groupBy("file", "request").agg(F.min("seq").alias("marker"))


def trend_delta(m: DataFrame) -> DataFrame:
    """How far each file's totals move from request to request: sizes of the moves, and their sum."""
    d = timeline(m).withColumn("delta", F.coalesce(F.col("total") - F.lag("total").over(_by()), F.lit(0)))
    return d.groupBy("file").agg(F.sum(F.abs("delta")).alias("churn"), F.sum("delta").alias("net"))


def trend_by_turn(turns: DataFrame) -> DataFrame:
    """Each turn's last request, and how many it has."""
    return turns.where(_is("assistant")).groupBy("file", "turn").agg(F.max("seq").alias("seq"), F.max_by("tokens", "seq").alias("tokens"), F.count(F.lit(1)).alias("steps"))


def step_brief(m: DataFrame) -> DataFrame:
    """What came in between two requests: how many messages, their tokens, and the first of them."""
    part = F.count_if(_is("assistant")).over(_before())
    rows = m.withColumn("step", F.coalesce(part, F.lit(0)))
    other = ~_is("assistant")
    return rows.groupBy("file", "step").agg(F.count_if(other).alias("inputs"), F.coalesce(F.sum(F.when(other, F.col("tokens"))), F.lit(0)).alias("input_tokens"), F.min(F.when(other, F.col("seq"))).alias("opener"), F.max(F.when(~other, F.col("seq"))).alias("response"))


def model_switches(requests: DataFrame) -> DataFrame:
    w = Window.partitionBy("session").orderBy("seq")
    return requests.withColumn("before", F.lag("model").over(w)).where(F.col("before") != F.col("model")).select("session", "seq", "before", "model")


def last_turns(turns: DataFrame, n: int = 2) -> DataFrame:
    return turns.withColumn("r", F.dense_rank().over(Window.partitionBy("file").orderBy(F.desc("turn")))).where(F.col("r") <= n).select("file", "seq", "turn")


def input_peaks(m: DataFrame) -> DataFrame:
    """The largest prompt of each file and where it was first reached."""
    return timeline(m).groupBy("file").agg(F.max("total").alias("peak"), F.min_by("seq", F.struct(-F.col("total"), "seq")).alias("peak_seq"))


def official_parts(m: DataFrame) -> DataFrame:
    """Each category's share of a file's official total, in whole tokens; what rounding leaves goes to the largest."""
    sums = categories(m).select("file", "cat", "tokens")
    w = Window.partitionBy("file")
    official = F.ceil(F.sum("tokens").over(w) / 100) * 100
    scaled = sums.withColumn("official", official).withColumn("part", F.floor(F.col("tokens") * F.col("official") / F.sum("tokens").over(w) + 0.5).cast("bigint"))
    largest = F.row_number().over(w.orderBy(F.desc("tokens"), "cat")) == 1
    return scaled.withColumn("rest", F.col("official") - F.sum("part").over(w)).select("file", "cat", "official", (F.col("part") + F.when(largest, F.col("rest")).otherwise(0)).alias("part"))


def billed_parts(m: DataFrame, rate: float = 0.75) -> DataFrame:
    return categories(m).select("file", "cat", F.floor(F.col("tokens") * rate + 0.5).cast("bigint").alias("billed"))
