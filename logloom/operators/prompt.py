"""System prompts and tools that are patched message by message, as they stand at any step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.surface import covering


def prompt_parts(patches: DataFrame) -> DataFrame:
    """Columns file, kind, name, value, born, since, until: what each part of a prompt is, and from which seq to before which.

    patches: file, seq, texts (array of strings that are added), sections (array of struct name, value;
    a null value deletes), removed (array of tool names) and added (array of struct name, value). In a
    patch tools are removed before others are added, so one that is both comes anew. A part that is set again
    keeps its place; one that was deleted and is set again goes to the end. born orders parts of a
    kind; until is null for what still holds. Empty texts and parts without a name are passed over.
    """
    key = ["file", "seq"]
    change = lambda kind, phase, column, name, value: patches.select(*key, F.posexplode(column).alias("n", "c")).select(*key, F.lit(kind).alias("kind"), F.lit(phase).alias("phase"), "n", name.alias("name"), value.alias("value"))
    c, nothing = F.col("c"), F.lit(None).cast("string")
    changes = change("section", 0, "sections", c["name"], c["value"]).unionByName(change("tool", 0, "removed", c, nothing)).unionByName(change("tool", 1, "added", c["name"], F.coalesce(c["value"], F.lit(""))))
    order = ["seq", "phase", "n"]
    of = Window.partitionBy("file", "kind", "name").orderBy(*order)
    there = F.col("value").isNotNull()
    begins = there & ~F.coalesce(F.lag(there).over(of), F.lit(False))
    known = changes.where("name IS NOT NULL").withColumns({"begins": begins, "until": F.lead("seq").over(of)})
    born = F.last(F.when(F.col("begins"), F.struct("seq", F.col("phase").cast("bigint").alias("phase"), F.col("n").cast("bigint").alias("n"))), True).over(of.rowsBetween(Window.unboundedPreceding, 0))
    held = known.withColumn("born", born).where(there & (F.col("until").isNull() | (F.col("until") > F.col("seq")))).select("file", "kind", "name", "value", "born", F.col("seq").alias("since"), "until")
    texts = patches.select(*key, F.posexplode("texts").alias("n", "value")).where("value <> ''")
    return held.unionByName(texts.select("file", F.lit("text").alias("kind"), nothing.alias("name"), "value", F.struct("seq", F.lit(0).cast("bigint").alias("phase"), F.col("n").cast("bigint").alias("n")).alias("born"), F.col("seq").alias("since"), F.lit(None).cast(patches.schema["seq"].dataType).alias("until")))


def prompt_at(parts: DataFrame, steps: DataFrame) -> DataFrame:
    """Columns file, seq, system, tools: for each step (file, seq) the prompt's text and the names of its tools, after the patches up to it.

    The text is the texts, then the sections in order, joined by a blank line. Parts and steps meet by blocks of places, so
    what is joined is what holds at a step and nothing else. A step without parts has an empty text and no tools.
    """
    asked = steps.select("file", "seq").distinct()
    most = asked.groupBy("file").agg(F.max("seq").alias("most"))
    spans = parts.join(most, "file").select("file", F.col("since").alias("lo"), F.coalesce(F.col("until") - 1, F.greatest("most", "since")).alias("hi"), F.struct(F.when(F.col("kind") == "text", 0).otherwise(1).alias("level"), "born", "kind", "name", "value").alias("part"))
    met = covering(asked.withColumn("at", F.col("seq")), spans, "part").groupBy("file", "seq").agg(F.collect_list("part").alias("parts"))
    text = F.filter("parts", lambda p: p["kind"].isin("text", "section") & (p["value"] != ""))
    system = F.array_join(F.transform(F.array_sort(text), lambda p: p["value"]), "\n\n")
    tools = F.transform(F.array_sort(F.filter("parts", lambda p: p["kind"] == "tool")), lambda p: p["name"])
    made = met.select("file", "seq", system.alias("system"), tools.alias("tools"))
    return asked.join(made, ["file", "seq"], "left").select("file", "seq", F.coalesce("system", F.lit("")).alias("system"), F.coalesce("tools", F.array().cast("array<string>")).alias("tools"))
