"""Graph operators: connected components by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.sources.shared import settle, spread


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every vertex of an undirected edge list with the smallest vertex it reaches.

    Returns (vertex, component). Vertices are any orderable type. NULL ends and self loops
    carry no information and are dropped; an empty edge list gives an empty result.

    Alternates the large-star and small-star steps: each replaces the edges at a vertex by
    edges to the smallest neighbour, so the graph turns into stars in a number of rounds
    logarithmic in the longest path, and every step is one grouped minimum and one join. Each
    round's edges are written to the shared folder, which cuts the lineage and survives lost
    executors.
    """
    e = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    )
    star = settle(e.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct())
    before = None
    for _ in range(max_rounds):
        star = settle(_small_star(_large_star(star)))
        # The sum of the labels falls until nothing moves any more.
        now = tuple(star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = star.groupBy(F.col("hi").alias("vertex")).agg(F.min("lo").alias("component"))
    roots = star.select(F.col("lo").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    return ends.unionByName(roots)


def vetoed_components(edges: DataFrame, weak: DataFrame) -> DataFrame:
    """Columns vertex, component: what edges join, and what weak edges join where no veto stands against it.

    edges has src, dst and vetoes (boolean); weak has src and dst. A group that edges join, one of
    which vetoes, takes part in no weak edge; all other groups are joined by theirs. What weak edges join has no
    vetoing edge, so the order of edges does not matter. A vertex of an edge that leads nowhere (null or the
    vertex itself) is a group of its own. Labels are the smallest vertex of a group.
    """
    ends = lambda e: e.select(F.explode(F.array("src", "dst")).alias("vertex"))
    every = ends(edges).union(ends(weak)).where("vertex IS NOT NULL").distinct()
    strong = connected_components(edges)
    of = settle(every.join(spread(strong), "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component")))
    held = edges.where("vetoes AND src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").alias("vertex")).distinct()
    vetoed = of.join(spread(held), "vertex", "left_semi").select(F.col("component").alias("vetoed")).distinct()
    free = of.join(spread(vetoed), F.col("component") == F.col("vetoed"), "left_anti")
    side = lambda at: free.select(F.col("vertex").alias(at), F.col("component").alias(f"{at}_group"))
    joined = weak.join(spread(side("src")), "src").join(spread(side("dst")), "dst").select(F.col("src_group").alias("src"), F.col("dst_group").alias("dst"))
    wider = connected_components(joined).select(F.col("vertex").alias("component"), F.col("component").alias("wider"))
    return of.join(spread(wider), "component", "left").select("vertex", F.coalesce("wider", "component").alias("component"))


def shared_object_edges(carriers: DataFrame) -> DataFrame:
    """Weak edges src, dst between each two carriers (node, object) of one object that follow each other by node."""
    known = carriers.where("node IS NOT NULL AND object IS NOT NULL").distinct()
    before = F.lag("node").over(Window.partitionBy("object").orderBy("node"))
    return known.select(before.alias("src"), F.col("node").alias("dst")).where("src IS NOT NULL")


def _large_star(star: DataFrame) -> DataFrame:
    """Join every larger neighbour of a vertex to the smallest one of its neighbourhood."""
    both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(star.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.join(spread(low), "u").where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    )


def _small_star(star: DataFrame) -> DataFrame:
    """Join every smaller neighbour of a vertex, and the vertex itself, to the smallest one."""
    low = star.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = star.join(spread(low), "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return low.select("hi", F.col("m").alias("lo")).unionByName(moved).distinct()
