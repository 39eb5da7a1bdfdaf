"""Operator 10, mixing sources to target weights: a hypergeometric splitting tree over block quotas."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.common import WORD, as_row, table
from logloom.sources.shared import settle


@dataclass(frozen=True)
class Mix:
    """Production parameters.

    weights: of the sources in order of code points (null last), repeating. share: words of the
    mix, in parts of all words. cap: most repeats of a source. block_docs: documents of a block
    on average. shard_bytes: text of an output shard about; their number is a power of two.
    shards: their number, instead. tree_shards: leaves of the splitting tree at most; each of
    them then holds several shards, to which a hash deals its documents. fan: blocks that are
    summed in one window at most. tries: orders in which the documents of the block where a
    target lies are tried. seed: of every draw.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2
    block_docs: int = 32
    shard_bytes: int = 32 << 20
    shards: int | None = None
    tree_shards: int = 4096
    fan: int = 1024
    tries: int = 64
    seed: int = 42

    def dealt(self, text_bytes: int) -> tuple[int, int]:
        """Leaves of the tree, a power of two, and shards of each."""
        asked = self.shards or max(1, -(-int(self.share * text_bytes) // self.shard_bytes))
        leaves = 1 << min(asked - 1, self.tree_shards - 1).bit_length()
        return leaves, -(-asked // leaves)


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Columns source_key, source, source_size, n_docs and target, one row per source.

    sizes has source_key, source, source_size and n_docs. A target is cap times the size where
    that is less than weight times a common level, which is as high as the share asks for. Sorted
    by the level at which each reaches its cap, the common level is the greatest of those that
    follow from what the sources before have left: it rises while sources are capped and falls
    from the first that is not.
    """
    ordered = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("rank") - 1) % len(mix.weights) + 1)
    capped = ordered.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(mix.cap))
    every, before = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * mix.share - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = capped.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return levelled.select("source_key", "source", "rank", "source_size", "n_docs", "bytes", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def hypergeometric(n_all: Column, n_kind: Column, n_drawn: Column, u: Column) -> Column:
    """How many of n_drawn draws without return, from n_all of which n_kind are of a kind, are of it.

    Inverse of the distribution function at u in [0, 1), from the ratio of neighbouring
    probabilities, over the values within eight standard deviations of the mean.
    """
    d = lambda c: c.cast("double")
    mean = d(n_drawn) * d(n_kind) / F.greatest(d(n_all), F.lit(1.0))
    spread = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - d(n_kind) / F.greatest(d(n_all), F.lit(1.0))) * d(n_all - n_drawn) / F.greatest(d(n_all) - 1, F.lit(1.0))))
    low = F.greatest(F.lit(0).cast("bigint"), n_drawn - (n_all - n_kind), F.floor(mean - 8 * spread) - 1)
    high = F.least(n_drawn, n_kind, F.ceil(mean + 8 * spread) + 1)
    ratio = lambda k: d(n_kind - k) * d(n_drawn - k) / (d(k + 1) * d(n_all - n_kind - n_drawn + k + 1))
    after = lambda w, k: F.when(k < high, w * ratio(k)).otherwise(F.lit(0.0))
    one = F.lit(1.0)
    total = F.aggregate(
        F.sequence(low, high), F.struct(one.alias("w"), F.lit(0.0).alias("sum")),
        lambda a, k: F.struct(after(a["w"], k).alias("w"), (a["sum"] + a["w"]).alias("sum")), lambda a: a["sum"],
    )
    mark = u * total
    found = F.aggregate(
        F.sequence(low, high), F.struct(one.alias("w"), F.lit(0.0).alias("sum"), low.alias("k")),
        lambda a, k: F.struct(after(a["w"], k).alias("w"), (a["sum"] + a["w"]).alias("sum"), F.when(a["sum"] <= mark, k).otherwise(a["k"]).alias("k")), lambda a: a["k"],
    )
    return F.when(low >= high, low).otherwise(found)


def splitting_tree(quotas: DataFrame, leaves: int, mix: Mix = Mix()) -> DataFrame:
    """Columns rank and tree, an array of 2 * leaves - 1: how many blocks of a source each node gets.

    quotas has rank and n (blocks of a source in the mix). Node 1, the root, holds all quotas;
    node k deals half of its blocks to its left child 2 k, source after source by a
    hypergeometric draw from what is left of the node, and the rest to the right one, 2 k + 1.
    So the sums over the leaves are the quotas exactly, leaves differ by few blocks, and what a
    leaf gets of the sources is as if all blocks had been shuffled.
    """
    nodes = settle(quotas.agg(F.sort_array(F.collect_list(F.struct("rank", "n"))).alias("counts")).select(F.lit(1).alias("node"), "counts"))
    levels = [nodes]
    while 1 << len(levels) <= leaves:
        u = lambda x: F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), F.col("node"), x["rank"]), 11).cast("double") / float(1 << 53)
        total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
        start = F.struct(total.alias("left"), F.floor(total / 2).cast("bigint").alias("draw"), F.array().cast("array<bigint>").alias("got"))

        def deal(a: Column, x: Column) -> Column:
            got = hypergeometric(a["left"], x["n"], a["draw"], u(x))  # noqa: B023
            grown = F.concat(a["got"], F.array(got))
            return F.struct((a["left"] - x["n"]).alias("left"), (a["draw"] - F.element_at(grown, -1)).alias("draw"), grown.alias("got"))

        halved = nodes.select("node", "counts", F.aggregate("counts", start, deal, lambda a: a["got"]).alias("got"))
        left = F.transform(F.arrays_zip("counts", "got"), lambda z: F.struct(z["counts"]["rank"].alias("rank"), z["got"].alias("n")))
        right = F.transform(F.arrays_zip("counts", "got"), lambda z: F.struct(z["counts"]["rank"].alias("rank"), (z["counts"]["n"] - z["got"]).alias("n")))
        children = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("counts")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("counts"))))
        nodes = settle(halved.select(children.alias("child")).select("child.node", "child.counts"))
        levels.append(nodes)
    each = reduce(DataFrame.unionByName, levels).select("node", F.explode("counts").alias("c")).select("node", "c.rank", "c.n")
    return each.groupBy("rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "n"))), lambda x: x["n"]).alias("tree"))


def leaf_of(tree: Column, position: Column, leaves: int) -> Column:
    """The leaf that draws the block copy at a position of its source: down the tree, left children first."""

    def step(a: Column, _: Column) -> Column:
        left = F.element_at(tree, a["node"] * 2)
        return F.when(a["at"] < left, F.struct((a["node"] * 2).alias("node"), a["at"].alias("at"))).otherwise(F.struct((a["node"] * 2 + 1).alias("node"), (a["at"] - left).alias("at")))

    depth = leaves.bit_length() - 1
    root = F.struct(F.lit(1).alias("node"), position.alias("at"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, step, lambda a: a["node"] - leaves) if depth else F.lit(0)


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", mix: Mix = Mix(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns `row`, size, source_size, target and placements, an array of (copy, shard, at).

    Each source's documents are dealt by a hash into numbered blocks. The mix takes as many
    whole passes over a source as its target holds, then the blocks of one more pass in order of
    number, up to the block where the target lies; of that block it takes the beginning of one
    of several random orders, the one whose words come nearest to the target. The splitting tree
    deals these block copies to output shards, from left to right, so no two draw the same; the
    copies of a document are those of its block that the tree has dealt. `at` orders a shard's
    documents at random.

    A null text has no words: size 0, and its placements add nothing. Null sources are one source,
    the last. Rows that are equal are taken each on its own, but in the last block of a source
    all or none of them; those of a null doc_id as well. A table without words has targets 0; an
    empty table gives an empty result. Reruns agree, since every draw is a hash of the row and
    the seed. docs is read twice, for its sizes and for its rows, so that texts need not be
    written down; it is to be a table or another frame that is the same each time.
    """
    return _placed(docs, text, source, doc_id, mix, keep)[0]


def _placed(docs: DataFrame, text: str, source: str, doc_id: str, mix: Mix, keep: tuple[str, ...] | None) -> tuple[DataFrame, int]:
    """What mix_sources returns, and how many output shards there are."""
    whole = F.col(text).cast("string")
    size = F.coalesce(F.regexp_count(whole, F.lit(WORD)), F.lit(0)).cast("bigint")
    name = F.col(source).cast("string")
    made = size.alias("size"), name.alias("source"), F.coalesce(F.concat(F.lit("s"), name), F.lit("n")).alias("source_key"), F.xxhash64(F.lit(mix.seed), F.col(doc_id), name, size).alias("key")
    rows = as_row(docs, keep, *made)
    measures = settle(docs.select(*made, F.coalesce(F.octet_length(whole), F.lit(0)).alias("bytes")))
    sizes = measures.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"), F.sum("bytes").alias("bytes"))
    quota = F.round("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / mix.block_docs)).cast("bigint")
    targets = settle(
        source_targets(sizes, mix).withColumn("passes", passes).withColumn("n_blocks", blocks).withColumn("rest", quota - F.col("passes") * F.col("source_size"))
    )
    most, text_bytes = targets.agg(F.max("n_blocks"), F.sum("bytes")).first()
    leaves, parts = mix.dealt(text_bytes or 0)
    dealt = measures.join(targets.select("source_key", "n_blocks", "rest"), "source_key").withColumn("block", F.pmod("key", "n_blocks"))
    edges = settle(targets.join(_edges(dealt, most or 1, mix), "source_key", "left").withColumns({"edge_block": F.coalesce("edge_block", F.lit(0).cast("bigint")), "gap": F.coalesce("gap", F.lit(0).cast("bigint"))}))
    fill = settle(_fill(dealt.join(edges.where("gap > 0").select("source_key", F.col("edge_block").alias("block"), "gap"), ["source_key", "block"]), mix))
    quotas = edges.withColumn("n", F.col("passes") * F.col("n_blocks") + F.col("edge_block") + F.when(F.col("gap") > 0, 1).otherwise(0))
    plan = settle(quotas.join(splitting_tree(quotas.select("rank", "n"), leaves, mix), "rank").select("source_key", "source_size", "target", "n_blocks", "edge_block", "gap", "tree"))
    met = rows.join(plan, "source_key").withColumn("block", F.pmod("key", "n_blocks")).join(fill, ["source_key", "key"], "left")
    # The tree's root holds all block copies; those of a block are at its number and every n_blocks after it.
    drawn = F.ceil((F.element_at("tree", 1) - F.col("block")) / F.col("n_blocks"))
    left_out = (F.col("block") == F.col("edge_block")) & (F.col("gap") > 0) & F.col("filled").isNull()
    copies = (F.greatest(drawn, F.lit(0)) - left_out.cast("bigint")).cast("bigint")
    leaf = lambda c: leaf_of(F.col("tree"), c * F.col("n_blocks") + F.col("block"), leaves)
    part = lambda c: F.pmod(F.xxhash64(F.lit(mix.seed), F.lit("part"), "key", c), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)
    placements = F.transform(
        F.when(copies > 0, F.sequence(F.lit(0).cast("bigint"), copies - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda c: F.struct(c.cast("int").alias("copy"), (leaf(c) * parts + part(c)).cast("int").alias("shard"), F.xxhash64(F.lit(mix.seed), "key", c).alias("at")),
    )
    return met.select("row", "size", "source_size", "target", placements.alias("placements")), leaves * parts


def _edges(dealt: DataFrame, most: int, mix: Mix) -> DataFrame:
    """Columns source_key, edge_block and gap: the block where a source's rest ends, and how much of it is missing before.

    Blocks are summed in wide ranges first, then in narrower ones within the range that holds the
    end, so that no window has more than `fan` rows, however many blocks a source has.
    """
    sums = settle(dealt.groupBy("source_key", "rest", "block").agg(F.sum("size").alias("words")))
    width = 1
    while width * mix.fan < most:
        width *= mix.fan
    at = sums.select("source_key").distinct().select("source_key", F.lit(0).cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("before"))
    while width:
        inside = sums.join(at, "source_key").where((F.col("block") >= F.col("first")) & (F.col("block") < F.col("first") + width * mix.fan))
        ranges = inside.groupBy("source_key", "rest", "before", F.expr(f"block div {width}").alias("range")).agg(F.sum("words").alias("words"))
        upto = ranges.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("source_key").orderBy("range")))
        found = upto.where(F.col("upto") > F.col("rest")).groupBy("source_key").agg(F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("before"), "rest")).alias("f"))
        at = settle(found.select("source_key", (F.col("f.range") * width).alias("first"), "f.before", "f.rest"))
        done, at = at, at.drop("rest")
        width //= mix.fan
    return done.select("source_key", F.col("first").alias("edge_block"), (F.col("rest") - F.col("before")).alias("gap"))


def _fill(edge: DataFrame, mix: Mix) -> DataFrame:
    """Columns source_key, key and filled: the documents of the edge block that the mix takes once more.

    Of each of several random orders every beginning is tried; the one nearest to the gap is
    taken, or none if that is as near.
    """
    units = edge.groupBy("source_key", "gap", "key").agg(F.sum("size").alias("size"))
    order = F.xxhash64(F.lit(mix.seed), "try", "key"), F.col("key")
    per = Window.partitionBy("source_key", "try").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tried = units.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(mix.tries - 1)))).withColumn("sum", F.sum("size").over(per)).withColumn("place", F.count(F.lit(1)).over(per))
    best = settle(tried.groupBy("source_key").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("sum")).alias("off"), "try", "place")).alias("b"), F.first("gap").alias("none")).where("b.off < none").select("source_key", "b.try", "b.place"))
    chosen = units.join(best, "source_key").withColumn("own", F.row_number().over(Window.partitionBy("source_key").orderBy(*order)))
    return chosen.where(F.col("own") <= F.col("place")).select("source_key", "key", F.lit(True).alias("filled"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", mix: Mix = Mix()) -> DataFrame:
    """The mix itself: rows of docs, repeated as often as taken, shard by shard in random order.

    Documents without words are left out, as they hold none of the words that the mix counts.
    """
    placed, shards = _placed(docs, text, source, doc_id, mix, None)
    each = placed.where(F.col("size") > 0).select("row", F.explode("placements").alias("p"))
    return each.repartition(shards, F.col("p.shard")).sortWithinPartitions("p.shard", "p.at", "p.copy").select("row.*")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), keep=("doc_id",))
    shards = F.array_join(F.transform("placements", lambda p: p["shard"].cast("string")), ",")
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.size("placements")).alias("taken"), shards.alias("shards"))
