"""What a context holds over time: its nodes, what takes their place, and where each of them goes.

Events have file, seq (unique in a file), kind, cat, tokens, first, last and shadowed. Kinds that
count here are `node`, `system` (a system prompt), `compaction` and `prune`; others are passed over,
and so are rows without file or seq. A node with first and last replaces others:

* A system prompt removes what lies from first to last.
* Any other node that comes next after a compaction or prune with shadowed places removes these.
* Any other takes the place of the span from first to last in the order of the surface, if both
  ends are there at that time; if not, it is added at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.sources.shared import settle, spread

_KEY = ["file", "seq"]


def _marked(events: DataFrame) -> DataFrame:
    """The nodes, how each replaces others (cut, claim, span or null), and the claim that it takes up."""
    known = events.where(F.col("file").isNotNull() & F.col("seq").isNotNull() & F.col("kind").isin("node", "system", "compaction", "prune"))
    before = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    node = F.col("kind").isin("node", "system")
    armed = F.last(F.when(~node & F.col("shadowed").isNotNull(), F.struct("seq", "shadowed")), True).over(before)
    rows = known.withColumn("armed", armed).withColumn("node_before", F.max(F.when(node, F.col("seq"))).over(before)).where(node)
    fresh = F.col("armed").isNotNull() & (F.col("node_before").isNull() | (F.col("armed.seq") > F.col("node_before"))) & (F.size("armed.shadowed") > 0)
    system = F.col("kind") == "system"
    how = F.when(F.col("first").isNull() | F.col("last").isNull(), F.lit(None).cast("string")).when(system, "cut").when(fresh, "claim").otherwise("span")
    claimed = how == "claim"
    return rows.select(*_KEY, system.alias("system"), "cat", "tokens", how.alias("how"), "first", "last", F.when(claimed, F.col("armed.seq")).alias("claim_seq"), F.when(claimed, F.col("armed.shadowed")).alias("shadowed"))


def covering(points: DataFrame, spans: DataFrame, *columns: str) -> DataFrame:
    """Every point (file, seq, at) with each span (file, lo, hi) that holds its `at`, and those columns of the span.

    A span is cut into blocks of two to the power of k places, two of each k at most, and a point
    lies in one block of each k that its file has; so points and spans meet in an equi-join.
    """
    sized = spans.where("lo <= hi").withColumn("k", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("hi") - F.col("lo") + 1)) - 1)))
    cut = sized.withColumn("l", F.expr("shiftright(lo + shiftleft(1L, k) - 1, k)")).withColumn("r", F.expr("shiftright(hi + 1, k)")).where("l < r")
    blocks = cut.select("file", "k", *columns, F.explode(F.expr("filter(array(if((l & 1) = 1, l, null), if((r & 1) = 1, r - 1, null)), b -> b is not null)")).alias("block"))
    placed = points.join(spread(blocks.select("file", "k").distinct()), "file").select(*_KEY, "k", F.expr("shiftright(at, k)").alias("block"))
    return placed.join(spread(blocks), ["file", "k", "block"]).select(*_KEY, *columns)


def first_cover(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Columns file, seq, gone: the first `by` after seq of the spans (file, lo, hi, by) that hold the point's `at`."""
    return covering(points, spans, "by").where("by > seq").groupBy(*_KEY).agg(F.min("by").alias("gone"))


def _at(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """Nodes with `at`: the place of the span that a node has taken, else its own."""
    moved = spans.where(F.col("lo").isNotNull()).select("file", F.col("by").alias("seq"), F.col("lo").alias("moved"))
    return nodes.join(spread(moved), _KEY, "left").withColumn("at", F.coalesce("moved", "seq")).drop("moved")


def _accepted(spans: DataFrame, ends: DataFrame) -> DataFrame:
    """Columns file, by, lo, hi: the spans whose ends are there in time, by place; lo is null for others.

    Whether a span's ends are there depends on earlier spans alone. So every round settles at least
    one more replacement of each file; logs whose spans are all accepted take two rounds.
    """
    now, before = settle(spans.select("file", "by", F.col("first").alias("lo"), F.col("last").alias("hi"))), None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("file", "by", F.coalesce("lo", F.lit(-1)), F.coalesce("hi", F.lit(-1)), F.col("lo").isNull()).cast("decimal(38,0)"))).first())
        if mark == before:
            return now
        before = mark
        at = _at(ends, now)
        seen = at.join(spread(first_cover(at, now)), _KEY, "left").select(*_KEY, "at", F.least("gone", "removed").alias("gone"))
        end = lambda name, of=seen: of.select("file", F.col("seq").alias(name), F.col("at").alias(f"{name}_at"), F.col("gone").alias(f"{name}_gone"))
        both = spans.join(spread(end("first")), ["file", "first"], "left").join(spread(end("last")), ["file", "last"], "left")
        there = [F.coalesce((F.col(e) < F.col("by")) & (F.col(f"{e}_gone").isNull() | (F.col(f"{e}_gone") >= F.col("by"))), F.lit(False)) for e in ("first", "last")]
        ok = there[0] & there[1] & F.coalesce(F.col("first_at") <= F.col("last_at"), F.lit(False))
        now = settle(both.select("file", "by", F.when(ok, F.col("first_at")).alias("lo"), F.when(ok, F.col("last_at")).alias("hi")))


def surface_nodes(events: DataFrame) -> DataFrame:
    """Columns file, seq, cat, tokens, pos, gone: every node, its place on the surface and the event that removes it, or null."""
    nodes = settle(_marked(events))
    claims = nodes.where("how = 'claim'").select("file", F.col("seq").alias("by"), F.explode("shadowed").alias("seq")).where("seq < by").groupBy(*_KEY).agg(F.min("by").alias("claimed"))
    cuts = nodes.where("how = 'cut'").select("file", F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("seq").alias("by"))
    cut = first_cover(nodes.select(*_KEY, F.col("seq").alias("at")), cuts).withColumnRenamed("gone", "cut")
    known = settle(nodes.join(spread(claims), _KEY, "left").join(spread(cut), _KEY, "left").withColumn("removed", F.least(F.when(~F.col("system"), F.col("claimed")), "cut")).drop("claimed", "cut", "shadowed"))
    spans = settle(known.where("how = 'span'").select("file", F.col("seq").alias("by"), "first", "last"))
    asked = spans.select("file", F.col("first").alias("seq")).unionByName(spans.select("file", F.col("last").alias("seq"))).distinct()
    ends = settle(known.where(~F.col("system")).select(*_KEY, "removed").join(spread(asked), _KEY))
    taken = _accepted(spans, ends)
    at = settle(_at(known, taken))
    gone = first_cover(at.where(~F.col("system")).select(*_KEY, "at"), taken)
    return at.join(spread(gone), _KEY, "left").select(*_KEY, "cat", "tokens", F.col("at").alias("pos"), F.least("gone", "removed").alias("gone"))


def compactions(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Columns file, seq, kind, n, tokens of each compaction and prune; nodes are those of surface_nodes.

    tokens: what was freed, less the node put in its place; as stated where no node took it up. n:
    the places that a compaction names.
    """
    taken = _marked(events).where("claim_seq is not null").select("file", F.col("claim_seq").alias("seq"), F.col("seq").alias("gone"), F.col("tokens").alias("added"))
    removed = nodes.where(F.col("gone").isNotNull()).groupBy("file", "gone").agg(F.sum("tokens").alias("removed"))
    # A node that takes up a claim may find none of the named places there.
    freed = taken.join(spread(removed), ["file", "gone"], "left").select(*_KEY, F.greatest(F.lit(0), F.coalesce("removed", F.lit(0)) - F.coalesce("added", F.lit(0))).alias("freed"))
    own = events.where(F.col("kind").isin("compaction", "prune") & F.col("file").isNotNull() & F.col("seq").isNotNull())
    n = F.when((F.col("kind") == "compaction") & F.col("shadowed").isNotNull(), F.size("shadowed"))
    return own.join(spread(freed), _KEY, "left").select(*_KEY, "kind", n.alias("n"), F.coalesce("freed", "tokens", F.lit(0)).alias("tokens"))
