"""Which records and sessions belong together: forks, bases, superseded logs, and what stays in a context."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators.surface import first_cover
from logloom.sources.shared import settle


def own_records(forks: DataFrame, parents: DataFrame) -> DataFrame:
    """Records of forks without the prefix that they inherit.

    forks has file, parent, seq and print; parents file, seq and print, as text. A fork's record is
    inherited if the parent has its print after all that earlier records were found at; the first such
    place is where it is found. From the first miss on all records are the fork's own. Only the parent's
    records of prints that the fork has are sent to it; a file is walked in one task, in order, and
    what is held there are those places.
    """
    asked = forks.where(F.col("parent").isNotNull()).select("file", "parent", "print").distinct()
    places = asked.join(parents.select(F.col("file").alias("parent"), "print", F.col("seq").alias("at")), ["parent", "print"]).select("file", "print", F.col("at").cast("bigint").alias("seq"), F.lit(0).alias("side"))
    both = forks.select("file", "print", F.col("seq").cast("bigint").alias("seq"), F.lit(1).alias("side")).unionByName(places)
    rows = both.repartition("file").sortWithinPartitions("file", "side", "seq")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, last, inherits = object(), {}, None, True
        for batch in batches:
            own = []
            columns = (batch.column(k).to_pylist() for k in range(4))
            for row, (file, print_, seq, side) in enumerate(zip(*columns, strict=True)):
                if file != now:
                    now, found, last, inherits = file, {}, None, True
                if side == 0:
                    found.setdefault(print_, []).append(seq)
                    continue
                places = found.get(print_, ()) if inherits and print_ is not None else ()
                k = 0 if last is None else bisect_right(places, last)
                inherits = k < len(places)
                if inherits:
                    last = places[k]
                else:
                    own.append(row)
            yield batch.select(["file", "seq", "print"]).take(pa.array(own, pa.int64()))

    types = {f.name: f.dataType for f in rows.schema.fields}
    return rows.mapInArrow(walk, T.StructType([T.StructField(c, types[c]) for c in ("file", "seq", "print")]))


def chains(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Columns id, root and depth from (id, base): each session's first ancestor and how far it is.

    Every round doubles the length of the jumps, so a chain of n links takes log2 n rounds of one
    join. Ids of a cycle have no first ancestor and are left out; a base that is no id is a root.
    """
    jumps = settle(links.select("id", F.coalesce("base", "id").alias("up"), F.when(F.col("base").isNull(), 0).otherwise(1).cast("bigint").alias("depth")))
    for _ in range(max_rounds):
        far = jumps.select(F.col("id").alias("mid"), F.col("up").alias("far"), F.col("depth").alias("more"))
        longer = settle(jumps.join(far, F.col("up") == F.col("mid"), "left").select("id", F.coalesce("far", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), ((F.col("far") != F.col("up")) & (F.col("up") != F.col("id"))).alias("moved")))
        jumps = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    ends = jumps.select(F.col("id").alias("end"), F.col("depth").alias("end_depth"))
    done = jumps.join(ends, F.col("up") == F.col("end"), "left").where(F.coalesce("end_depth", F.lit(0)) == 0)
    return done.select("id", F.col("up").alias("root"), "depth")


def newest_logs(logs: DataFrame) -> DataFrame:
    """Of the logs of one thread the newest; of equally new ones the greatest id."""
    return logs.withColumn("place", F.row_number().over(Window.partitionBy("thread").orderBy(F.desc("at"), F.desc("id")))).where("place = 1").select("thread", "id", "at")


def context_intervals(nodes: DataFrame) -> DataFrame:
    """Columns file, seq, cat, gone and reason: from where on a node is no longer in the context.

    nodes has file, seq, cat, compacts (replaces every node before it but `kept` ones), prunes
    (drops tool results before it) and undoes_to (drops the nodes from that seq up to itself; none
    if that seq is not before its own). What an undo drops stays dropped when the undo is undone: for
    that, see forest.surface_after_restores. The first of them that reaches a node ends it; at the same record in that order.
    """
    after = Window.partitionBy("file").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    nearest = lambda when: F.min(F.when(when, F.col("seq"))).over(after)
    compacted = F.when(~F.col("kept"), nearest(F.col("compacts")))
    pruned = F.when(F.col("cat") == "tool", nearest(F.col("prunes")))
    undos = nodes.where(F.col("undoes_to") < F.col("seq")).select("file", F.col("undoes_to").cast("bigint").alias("lo"), (F.col("seq") - 1).alias("hi"), F.col("seq").alias("by"))
    undone = first_cover(nodes.select("file", "seq", F.col("seq").alias("at")), undos).withColumnRenamed("gone", "undone")
    out = nodes.withColumn("compacted", compacted).withColumn("pruned", pruned).join(undone, ["file", "seq"], "left")
    gone = F.least("compacted", "pruned", "undone")
    reason = F.when(gone == F.col("compacted"), "compacted").when(gone == F.col("pruned"), "pruned").when(gone == F.col("undone"), "undone")
    return out.select("file", "seq", "cat", gone.alias("gone"), reason.alias("reason"))


def effective_system(nodes: DataFrame) -> DataFrame:
    """For each node the last system prompt before it that has tokens."""
    before = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.select("file", "seq", F.max(F.when((F.col("cat") == "system") & (F.col("tokens") > 0), F.col("seq"))).over(before).alias("system_seq"))


def context_items(nodes: DataFrame) -> DataFrame:
    """The nodes of a context as they are listed: system prompts, tool results, then the others, each in order."""
    group = F.when(F.col("cat") == "system", 0).when(F.col("cat") == "tool", 1).otherwise(2)
    return nodes.select("file", "seq", "cat", F.row_number().over(Window.partitionBy("file").orderBy(group, "seq")).cast("bigint").alias("place"))


def apportioned(steps: DataFrame) -> DataFrame:
    """A turn's total dealt to its steps in proportion to their weights, in whole tokens; the last step has what is left."""
    turn = Window.partitionBy("file", "turn")
    share = F.expr("total * weight div nullif(weights, 0)")
    shared = steps.withColumn("weights", F.sum("weight").over(turn)).withColumn("share", F.coalesce(share, F.lit(0)))
    last = F.row_number().over(turn.orderBy(F.desc("seq"))) == 1
    return shared.select("file", "turn", "seq", (F.col("share") + F.when(last, F.col("total") - F.sum("share").over(turn)).otherwise(0)).cast("bigint").alias("tokens"))


def title_of(text: Column, most: int = 80) -> Column:
    """A text on one line, cut with an ellipsis beyond a length."""
    line = F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f]+", " "))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.left(line, F.lit(most - 1))), F.lit("…"))).otherwise(line)


def session_meta(messages: DataFrame) -> DataFrame:
    """One row of each file: title (the first prompt), prompts, first and last record, records."""
    prompt = F.col("cat") == "user"
    return messages.groupBy("file").agg(
        title_of(F.min_by(F.when(prompt, F.col("text")), F.when(prompt, F.col("seq")))).alias("title"), F.count_if(prompt).alias("prompts"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("records"),
    )


def merged(*sources: Column) -> Column:
    """The first of the sources that is neither null nor empty."""
    return F.coalesce(*[F.nullif(s, F.lit("")) for s in sources])


def family_order(forest: DataFrame, cap: int = 25) -> DataFrame:
    """Columns root, place, id of the first `cap` nodes of each family in order of the walk, and `more` that follow.

    forest has root, id, parent, running and updated, nodes at most two levels under a root.
    Siblings come running first, then by last update, then by id.
    """
    among = Window.partitionBy("parent").orderBy(F.desc("running"), F.desc("updated"), "id")
    placed = forest.withColumn("own", F.row_number().over(among))
    up = placed.select(F.col("id").alias("up"), F.col("own").alias("up_own"), F.col("depth").alias("up_depth"))
    path = F.when(F.col("depth") == 0, F.array()).when(F.col("depth") == 1, F.array("own")).otherwise(F.array("up_own", "own"))
    ordered = placed.join(up, F.col("parent") == F.col("up"), "left").withColumn("path", path)
    place = F.row_number().over(Window.partitionBy("root").orderBy("path"))
    size = forest.groupBy("root").agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("more"))
    return ordered.withColumn("place", place).where(F.col("place") <= cap).join(size, "root").select("root", "place", "id", "more")
