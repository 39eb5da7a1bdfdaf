"""File activity, line counts, timing and the forms in which figures are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.sources.shared import settle

#: Forms of files by the end of their path, the first that fits.
FORMS = (("code", r"\.(ts|js|py|rs|go|java|c|cpp)$"), ("page", r"\.(html?|php)$"), ("data", r"\.(json|csv|xml|ya?ml)$"), ("image", r"\.(png|jpe?g|gif|svg)$"), ("text", r"\.(md|txt)$"))


def form_of(path: Column) -> Column:
    out = F.when(path == "", "none")
    for name, pattern in FORMS:
        out = out.when(F.lower(path).rlike(pattern), name)
    return out.otherwise("other")


def line_count(text: Column) -> Column:
    """Lines of a text: a last line counts with or without its break; nothing has none."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (breaks + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("bigint")


def file_activity(ops: DataFrame) -> DataFrame:
    """Of each path: reads and writes, lines added, the last touch."""
    return ops.groupBy("path").agg(F.count_if(F.col("op") == "read").alias("reads"), F.count_if(F.col("op") == "write").alias("writes"), F.sum("lines").alias("lines"), F.max("seq").alias("last_seq"))


def locate_steps(m: DataFrame) -> DataFrame:
    """For each user's message the first request after it, if before the next header."""
    w = Window.partitionBy("file").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    request, gone = F.min(F.when(F.col("cat") == "assistant", F.col("seq"))).over(w), F.min(F.when(F.col("cat") == "system", F.col("seq"))).over(w)
    return m.select("file", "seq", "cat", request.alias("request"), gone.alias("gone")).where("cat = 'user'").select("file", "seq", F.when(F.col("gone").isNull() | (F.col("request") < F.col("gone")), F.col("request")).alias("request"))


def humanized(n: Column) -> Column:
    """Numbers as a reader wants them: 999, 1.2K, 3.4M; cut to one decimal."""
    short = lambda unit, sign: F.concat(F.format_string("%.1f", F.floor(n * 10 / unit) / 10), F.lit(sign))
    return F.when(n < 1000, F.format_string("%d", n)).when(n < 1_000_000, short(1000, "K")).otherwise(short(1_000_000, "M"))


def timing_totals(spans: DataFrame) -> DataFrame:
    """Of each file: wall time from first to last, time in spans, time to the first of them, tokens a second.

    A first span's wait counts from the file's start.
    """
    ms = F.col("end") - F.col("start")
    sums = spans.groupBy("file").agg((F.max("end") - F.min("start")).alias("wall_ms"), F.sum(ms).alias("busy_ms"), F.min_by(ms, F.struct("start", "seq")).alias("first_ms"), F.sum("k").alias("k"))
    return sums.select("file", "wall_ms", "busy_ms", "first_ms", F.when(F.col("busy_ms") > 0, F.round(F.col("k") * 1000 / F.col("busy_ms"), 1)).alias("per_second"))


def timing_shares(spans: DataFrame) -> DataFrame:
    """Parts of the wall time: busy, at most all of it, and what is left; null where there is none."""
    t = timing_totals(spans)
    busy = F.least("busy_ms", "wall_ms")
    return t.select("file", F.when(F.col("wall_ms") > 0, F.round(busy / F.col("wall_ms"), 6)).alias("busy"), F.when(F.col("wall_ms") > 0, F.round(1 - busy / F.col("wall_ms"), 6)).alias("idle"))


def top_tools(spans: DataFrame, top: int = 16) -> DataFrame:
    """The tools of most time in each file; exact, whatever their number."""
    per = spans.groupBy("file", F.concat("lane", F.lit("-"), (F.col("k") % 7).cast("string")).alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("end") - F.col("start")).alias("ms"))
    return per.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("ms"), "tool"))).where(F.col("r") <= top).drop("r")


def decode_spans(spans: DataFrame) -> DataFrame:
    """Time by kind where each block lasts until the next begins, the last until the file's end."""
    until = F.coalesce(F.lead("start").over(Window.partitionBy("file").orderBy("start", "seq")), F.max("end").over(Window.partitionBy("file")))
    return spans.withColumn("ms", until - F.col("start")).groupBy("file", "lane").agg(F.sum("ms").alias("ms"))


def agent_forest(nodes: DataFrame) -> DataFrame:
    """Each agent with its depth, its root and the path to it.

    nodes has id, parent, label and weight; levels are joined one after another, for as many as
    there are, each written down once. Nodes whose parent does not exist are roots; those of a
    pure cycle, which no root reaches, are roots of their own as well.
    """
    ids = nodes.select(F.col("id").alias("up"))
    level = nodes.join(ids, F.col("parent") == F.col("up"), "left").where(F.col("up").isNull()).select("id", "label", "weight", F.lit(0).cast("bigint").alias("depth"), F.col("id").alias("root"), F.array("id").alias("path"))
    level = settle(level)
    out = level
    while not level.isEmpty():
        above = level.select(F.col("id").alias("up"), "depth", "root", "path")
        level = settle(nodes.join(above, F.col("parent") == F.col("up")).where(~F.array_contains("path", F.col("id"))).select("id", "label", "weight", (F.col("depth") + 1).alias("depth"), "root", F.concat("path", F.array("id")).alias("path")))
        out = out.unionByName(level)
    lost = nodes.join(out.select("id"), "id", "left_anti").select("id", "label", "weight", F.lit(0).cast("bigint").alias("depth"), F.col("id").alias("root"), F.array("id").alias("path"))
    return out.unionByName(lost).select("id", "label", "weight", "depth", "root", F.array_join("path", "/").alias("path"))


def subtree_sizes(forest: DataFrame) -> DataFrame:
    """Of each agent: the agents at and under it, and the sum of their weights."""
    up = forest.select(F.explode(F.split("path", "/")).alias("id"), "weight")
    return up.groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("weight"))
