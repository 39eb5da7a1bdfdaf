"""The near-duplicate stage of the pipeline: SimHash groups of operator 9, completed to all pairs at a Jaccard similarity.

Pairs at a similarity of 0.8 differ in about 10 of 64 bits, and up to 17; at that radius no branch
of a tree over Hamming distance can be cut off, as all other fingerprints lie about 32 bits away.
So trees find the pairs within a few bits, and an exact join of shingle sets finds the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import fields, map_batches, numbers
from logloom.llm.simhash_dedup import SimHash, near_links
from logloom.operators.graph import connected_components
from logloom.sources.shared import settle


@dataclass(frozen=True)
class NearCopies:
    """Production parameters.

    shingle: words. part, whole: near copies share at least part / whole of the shingles that
    either has. sample, common: a shingle in `common` of about `sample` distinct texts is put
    last in every set; this orders the search and has no effect on what is found. seed: of the
    shingles' hashes. broadcast_rows: up to so many asked texts are picked where they are
    read, by a broadcast of 16 bytes each; beyond it, texts move to an equal join. rounds: of
    joining groups before all pairs across groups are compared, of texts around a centre too; crowd: texts of one shingle from
    which on they are compared by what sets them apart from a text in their midst; least: share
    of both that a text and that one hold in common; hubs: texts joined to that one that others are
    asked about first, of each element. None of these has an effect on what is found.
    """

    shingle: int = 5
    part: int = 4
    whole: int = 5
    sample: int = 2000
    common: int = 3
    seed: int = 42
    broadcast_rows: int = 2_000_000
    rounds: int = 4
    crowd: int = 64
    least: float = 0.5
    hubs: int = 4

    def prefix(self, n: int) -> int:
        """Least elements of a set of n of which any near copy has one."""
        return n - -(-self.part * n // self.whole) + 1

    def sizes(self, n: str, m: str):
        """Whether sets of these sizes (columns) can be near copies."""
        return self.whole * F.least(n, m) >= self.part * F.greatest(n, m)

    def near(self, shared, n, m):
        """Whether sets of n and m elements, `shared` of them in both, are near copies."""
        return (self.part + self.whole) * shared >= self.part * (n + m)

    def apart(self, differing, n, m):
        """The same, of sets that differ in so many elements."""
        return (self.part + self.whole) * differing <= (self.whole - self.part) * (n + m)


#: Bits that a shingle is cut by where prefixes meet, which makes rows smaller; what meets by chance is told apart later.
_CUT = 20


def fingerprint(hashes: np.ndarray) -> int:
    """The bits, but the highest, that are set in over half of a text's distinct shingles."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    ones[63] = 0
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def shingles(text: str | None, how: NearCopies = NearCopies(), last: np.ndarray | None = None) -> np.ndarray:
    """The text's distinct shingles as sorted 63-bit hashes; those in `last` have the highest bit set.

    Words are in lower case; a text of fewer words than a shingle is one shingle.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = max(1, len(words) - how.shingle + 1)
    out = np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[k : k + how.shingle]), how.seed) for k in range(n)), np.uint64, n) >> np.uint64(1))
    if last is not None and len(last):
        out[np.isin(out, last, assume_unique=True)] |= np.uint64(1 << 63)
        out.sort()
    return out


def _common(texts: DataFrame, how: NearCopies) -> np.ndarray:
    """Shingles that many texts of a bounded sample hold."""
    rate = min(1.0, how.sample / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(rate * (1 << 20))).distinct()

    def of(batch: pa.RecordBatch) -> list:
        return [pa.array(np.concatenate([np.zeros(0, np.uint64), *[shingles(t, how) for t in batch.column(0).to_pylist()]]).view(np.int64))]

    often = map_batches(some, of, fields("h bigint"), text=0).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= how.common)
    return np.sort(often.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def first_of_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", how: NearCopies = NearCopies(), trees: SimHash = SimHash(shingle=5)) -> DataFrame:
    """The documents, but of each group of near copies only that of the smallest id.

    A group is what chains of pairs with a Jaccard similarity of part / whole or more join; no
    pair is lost. Vantage-point trees (`trees`) find the pairs whose fingerprints differ in few
    bits, the join the rest; all are confirmed by whole sets. A null text counts as empty, and texts without words are copies of each other.
    Exactly one row of each group stays, also of repeated rows and of groups without ids.
    """
    name = "copy_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    tagged = docs.withColumn(name, F.xxhash64(F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`").isNull(), F.col(f"`{doc_id}`")))
    plain = tagged.select(F.col(f"`{doc_id}`").alias("id"), F.col(name).alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    last = docs.sparkSession.sparkContext.broadcast(_common(plain.select("text"), how))

    def ends_at(sets: list) -> np.ndarray:
        # The prefix's last element, with the highest bit turned so that signed numbers keep the order.
        return (np.array([s[how.prefix(len(s)) - 1] for s in sets], np.uint64) ^ np.uint64(1 << 63)).view(np.int64)

    def sign(batch: pa.RecordBatch) -> list:
        sets = [shingles(t, how, last.value) for t in batch.column(2).to_pylist()]
        digests = [xxhash.xxh64_intdigest(s.tobytes(), how.seed) for s in sets]
        return [batch.column(0), batch.column(1), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array(ends_at(sets)), [s[: how.prefix(len(s))].tobytes() for s in sets]]

    schema = fields("id bigint, key bigint, digest bigint, n bigint, fp bigint, tail bigint, prefix binary")
    schema["id"].dataType = plain.schema["id"].dataType
    rows = settle(map_batches(plain, sign, schema, text=2).withColumn("mark", F.monotonically_increasing_id()))
    # A set goes by the number of its first row. Prefixes stay in `rows`; they move for the pairs that are asked about alone.
    one = rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "key", "mark")).alias("f"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("tail").alias("tail"), F.count(F.lit(1)).alias("copies"))
    sets = settle(one.select(F.col("f.mark").alias("mark"), "digest", "f", "n", "fp", "tail", "copies"))
    again = _small(settle(sets.where("copies > 1").select("digest", F.col("mark").alias("first"))), how)
    prefixes = rows.select("digest", "mark", "prefix").join(again, "digest", "left").where("first IS NULL OR first = mark").select("mark", "prefix")

    # Texts of one fingerprint are asked about against the first of them, and firsts along the trees' links.
    first_of = settle(sets.groupBy("fp").agg(F.min("mark").alias("first")))
    of = lambda at: first_of.select(F.col("fp").alias(at), F.col("first").alias(f"{at}_first"))
    close = near_links(first_of.select("fp"), trees).join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_first").alias("a"), F.col("dst_first").alias("b"))
    close = close.unionByName(sets.join(first_of, "fp").where("mark <> first").select(F.col("first").alias("a"), F.col("mark").alias("b")))

    def spread(batch: pa.RecordBatch) -> list:
        found = [f >> np.uint64(_CUT) for f in numbers(batch.column(1))]
        return [pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), [len(f) for f in found]))]

    held = map_batches(prefixes, spread, fields("h bigint, mark bigint"))
    held = settle(held.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("c > 1"))
    mixed = held.join(held.groupBy("mark").agg(F.sum("c").alias("weight")), "mark").select("h", "mark", "weight", F.col("mark").alias("g"))
    # Groups are joined before pairs across groups are compared: in each round a set is asked about
    # against one other: the one that stands first at most of its shingles, where sets that share much with many stand first.
    asked, links = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), None
    tried = None
    for _ in range(how.rounds):
        led = mixed.withColumn("hub", F.max(F.struct("weight", "mark", "g")).over(Window.partitionBy("h"))).where("g <> hub.g")
        stars = led.groupBy(F.col("mark").alias("b"), F.col("hub.mark").alias("a")).agg(F.count(F.lit(1)).alias("n"))
        if tried is not None:
            stars = stars.join(tried.select("a", "b").union(tried.select("b", "a")), ["a", "b"], "left_anti")
        best = stars.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        asked = settle(asked.unionByName(best).distinct())
        tried = asked if tried is None else tried.unionByName(asked)
        found = _confirmed(_possible(asked, sets, prefixes, how), sets, plain, last, how)
        links = found if links is None else links.unionByName(found)
        own = mixed.drop("g").join(connected_components(links, "a", "b"), F.col("mark") == F.col("vertex"), "left").select("h", "mark", "weight", F.coalesce("component", "mark").alias("g"))
        span = own.withColumn("lo", F.min("g").over(Window.partitionBy("h"))).withColumn("hi", F.max("g").over(Window.partitionBy("h")))
        mixed = settle(span.where("lo < hi").select("h", "mark", "weight", "g"))
        if found.count() * 20 < asked.count():
            break
        asked = tried.limit(0)
    mixed = settle(mixed.join(sets.select("mark", "n", "tail"), "mark"))
    own = _around(mixed, sets, plain, last, how)
    links = links.unionByName(_beside(own, mixed, how))
    # Other pairs across groups meet at every shingle that both prefixes have, so these are counted and no prefix moves.
    met = _met(mixed, own, how)
    counted = met.groupBy(F.col("a_mark").alias("a"), F.col("b_mark").alias("b"), "a_n", "b_n", "a_tail", "b_tail").agg(F.count(F.lit(1)).alias("shared"))
    rest = lambda n: F.floor((how.part * F.col(n) + how.whole - 1) / how.whole) - 1
    left = F.when(F.col("a_tail") <= F.col("b_tail"), rest("a_n")).otherwise(rest("b_n"))
    across = settle(counted.where(how.near(F.col("shared") + left, F.col("a_n"), F.col("b_n"))).select("a", "b"))
    links = links.unionByName(_confirmed(across, sets, plain, last, how))
    group = sets.select("mark", "f").join(connected_components(links, "a", "b"), F.col("mark") == F.col("vertex"), "left")
    times = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    first = group.groupBy(F.coalesce("component", "mark").alias("g")).agg(F.min("f").alias("f")).select(F.col("f.key").alias("key"))
    first = settle(first.join(times, "key").select(F.col("key").alias(name), "times"))
    # Only of repeated rows one has to be picked; the texts of all others need not move for it.
    of = lambda which: tagged.join(_small(first.where(which).select(name), how), name, "left_semi")
    place = name + "_place"
    picked = of("times > 1").withColumn(place, F.row_number().over(Window.partitionBy(name).orderBy(name))).where(F.col(place) == 1).drop(place)
    return of("times = 1").unionByName(picked).select(*[F.col(f"`{c}`") for c in docs.columns])


def _either(pairs: DataFrame) -> DataFrame:
    """Column mark: every end of the pairs (a, b)."""
    return pairs.select(F.col("a").alias("mark")).union(pairs.select("b")).distinct()


def _small(rows: DataFrame, how: NearCopies) -> DataFrame:
    """A settled frame, broadcast where it is short enough, so that the texts that it is joined to do not move."""
    return F.broadcast(rows) if rows.count() <= how.broadcast_rows else rows


def _ends(of: DataFrame, at: str, *cols: str) -> DataFrame:
    return of.select(F.col("mark").alias(at), *[F.col(c).alias(f"{at}_{c}") for c in cols])


def _possible(pairs: DataFrame, sets: DataFrame, prefixes: DataFrame, how: NearCopies) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and prefixes let them be near copies."""

    def may(batch: pa.RecordBatch) -> list:
        keep = np.zeros(batch.num_rows, bool)
        for i, (n, m, p, q) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), numbers(batch.column(4)), numbers(batch.column(5)), strict=True)):
            # Up to the end of the prefix that ends first, all that both have is known.
            left = n - len(p) if p[-1] <= q[-1] else m - len(q)
            keep[i] = how.near(len(np.intersect1d(p, q, True)) + left, n, m)
        return [batch.column(k).filter(pa.array(keep)) for k in (0, 1)]

    alike = settle(pairs.join(_ends(sets, "a", "n"), "a").join(_ends(sets, "b", "n"), "b").where(how.sizes("a_n", "b_n")).select("a", "b", "a_n", "b_n"))
    of = settle(prefixes.join(_small(settle(_either(alike)), how), "mark", "left_semi"))
    met = alike.join(_ends(of, "a", "prefix"), "a").join(_ends(of, "b", "prefix"), "b")
    return settle(map_batches(met.select("a", "b", "a_n", "b_n", "a_prefix", "b_prefix"), may, fields("a bigint, b bigint")))


def _around(mixed: DataFrame, sets: DataFrame, plain: DataFrame, last, how: NearCopies) -> DataFrame:
    """Columns mark, centre, n, m, k, near, adds, lacks: the texts of crowded shingles, and the k elements that each one or its centre alone has.

    The centre is the hub of most of a text's crowded shingles; n, m: both sizes; near: whether they are near copies.
    Texts that have too little in common with it are left out, and so are compared as all others.
    """
    hubs = settle(mixed.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("weight", "mark", "n")).alias("hub")).where(F.col("c") > how.crowd).select("h", F.col("hub.mark").alias("centre"), F.col("hub.n").alias("m")))
    often = mixed.join(_small(hubs, how), "h").where(how.sizes("n", "m")).groupBy("mark", "centre").agg(F.count(F.lit(1)).alias("times"))
    of = settle(often.groupBy("mark").agg(F.max_by("centre", F.struct("times", -F.col("centre"))).alias("centre")))

    def differ(batch: pa.RecordBatch) -> list:
        out: list[list] = [[] for _ in range(8)]
        for mark, centre, p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), numbers(batch.column(2)), numbers(batch.column(3)), strict=True):
            adds, lacks = np.setdiff1d(p, q, True), np.setdiff1d(q, p, True)
            apart = len(adds) + len(lacks)
            if apart <= (1 - how.least) * (len(p) + len(q)):
                for k, v in enumerate((mark, centre, len(p), len(q), apart, bool(how.apart(apart, len(p), len(q))), adds.view(np.int64), lacks.view(np.int64))):
                    out[k].append(v)
        return out

    full = _full(of.select("mark").union(of.select("centre")).distinct(), sets, plain, last, how)
    # Many texts may have one centre, which is therefore sent to several tasks.
    spread = 16
    centres = _ends(full, "centre", "words").join(of.select("centre").distinct(), "centre").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    both = of.join(full, "mark").withColumn("part", F.pmod(F.xxhash64("mark"), F.lit(spread)).cast("int")).join(centres, ["centre", "part"])
    return settle(map_batches(both.select("mark", "centre", "words", "centre_words"), differ, fields("mark bigint, centre bigint, n bigint, m bigint, k bigint, near boolean, adds array<bigint>, lacks array<bigint>")))


def _shared(own: DataFrame, how: NearCopies) -> DataFrame:
    """A row for each element d that sets a text apart from its centre and by which it can be found to be a near copy of another.

    A text's elements stand in one order for all texts of the centre, those that fewest texts have first. adds, lacks:
    how many that the centre has not, and that it alone has, are left from d on. Texts
    that have d first in common share the lesser of both at most, and rows in which that is too little
    for any text are left out. far: whether it is enough for one that is not near the centre, as texts near it are not told apart from each other.
    """
    spans = own.groupBy("centre").agg(F.min("n").alias("lo"))
    kind = lambda of, added: own.select("centre", "mark", "g", "n", "m", "k", "near", F.lit(added).alias("added"), F.explode(of).alias("d"))
    each = kind("adds", True).unionByName(kind("lacks", False))
    often = each.groupBy("centre", "d").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    back = Window.partitionBy("mark").orderBy(F.col("c").desc(), F.col("d").desc())
    left = lambda added: F.count(F.when(F.col("added") == added, F.lit(1))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    placed = each.join(often, ["centre", "d"]).withColumn("adds", left(True)).withColumn("lacks", left(False)).join(spans, "centre")
    rest = F.col("adds") + F.col("lacks")
    whole, share = how.part + how.whole, how.whole - how.part
    # Of near copies the other has rest elements at least and is `whole / part` times as large at most; one not near the centre differs from that in over its share.
    able = how.part * (F.col("k") - rest) <= share * F.col("n")
    far = whole * (F.col("k") - 2 * rest) < share * (F.col("n") - F.col("m"))
    # If the other lacks no more than both do, they still differ in k - 2 * adds and by its size over the centre's; that is least for the smallest size.
    able &= whole * (F.col("k") + F.col("lo") - F.col("m") - 2 * F.col("adds")) <= share * (F.col("n") + F.col("lo"))
    return settle(placed.withColumn("far", far).where(able & (~F.col("near") | F.col("far"))).drop("c", "m", "lo", "near", "added"))


def _meeting(b: DataFrame, a: DataFrame, how: NearCopies) -> DataFrame:
    """Pairs of rows of `_shared` in different groups that can be the first element that near copies have in common."""
    side = lambda of, at: of.select("centre", "d", *[F.col(c).alias(f"{at}_{c}") for c in ("mark", "g", "n", "k", "adds", "lacks", "joined")])
    rest = F.least("a_adds", "b_adds") + F.least("a_lacks", "b_lacks")
    enough = how.apart(F.col("a_k") + F.col("b_k") - 2 * rest, F.col("a_n"), F.col("b_n"))
    return side(b, "b").join(side(a, "a"), ["centre", "d"]).where((F.col("a_joined") | (F.col("b_mark") < F.col("a_mark"))) & (F.col("a_g") != F.col("b_g")) & enough)


def _told(pairs: DataFrame, own: DataFrame, how: NearCopies) -> DataFrame:
    """Those of the pairs (a, b) of one centre that are near copies, by what sets each apart from it."""
    met = pairs.join(_ends(own, "a", "k", "n", "adds", "lacks"), "a").join(_ends(own, "b", "k", "n", "adds", "lacks"), "b")
    both = F.size(F.array_intersect("a_adds", "b_adds")) + F.size(F.array_intersect("a_lacks", "b_lacks"))
    differing = F.col("a_k") + F.col("b_k") - 2 * both
    return settle(met.where(how.apart(differing, F.col("a_n"), F.col("b_n"))).select("a", "b"))


def _beside(own: DataFrame, mixed: DataFrame, how: NearCopies) -> DataFrame:
    """Links (a, b) that join all near copies of one centre that mixed has in different groups.

    Two of them that are near copies either meet at an element that sets both apart from the centre,
    or are near copies of it: with none in common they differ in k + l elements, and the centre has
    at least m - l of them, so k + l being few enough for sizes n and m, k is for n and the centre's.
    Groups near the centre are joined by it. Others ask a few of the joined texts of each element first, so that
    what near copies there are is found by rows in proportion to the elements; groups that are then still apart are compared with all that may be near.
    """
    own = settle(own.join(mixed.groupBy("mark").agg(F.first("g").alias("g")), "mark"))
    each = _shared(own, how)
    links = own.where("near AND mark <> centre").select(F.col("mark").alias("a"), F.col("centre").alias("b"))
    joined = own.where("near").select("centre", "g").distinct()
    in_of = lambda groups: each.join(groups.withColumn("in", F.lit(True)), ["centre", "g"], "left").withColumn("joined", F.coalesce("in", F.lit(False))).drop("in")
    rows = settle(in_of(joined))
    for turn in range(how.rounds):
        # At first those that leave most to share, then others.
        first = (2 * (F.col("adds") + F.col("lacks")) - F.col("k")).desc() if turn == 0 else F.xxhash64("mark", F.lit(turn))
        at = F.row_number().over(Window.partitionBy("centre", "d").orderBy(first, "mark"))
        hubs = rows.where("joined AND far").withColumn("at", at).where(F.col("at") <= how.hubs).drop("at")
        found = _told(_meeting(rows.where("NOT joined"), hubs, how).select(F.col("a_mark").alias("a"), F.col("b_mark").alias("b")).distinct(), own, how)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        joined = settle(joined.union(found.select(F.col("b").alias("mark")).join(own, "mark").select("centre", "g")).distinct())
        rows = settle(in_of(joined))
    met = _meeting(rows.where("NOT joined"), rows.where("far"), how)
    others = _told(met.select(F.col("a_mark").alias("a"), F.col("b_mark").alias("b")).distinct(), own, how)
    return settle(links.unionByName(others))


def _met(mixed: DataFrame, own: DataFrame, how: NearCopies) -> DataFrame:
    """Pairs of different groups and not of one centre, once for each shingle that both prefixes have."""
    known = mixed.join(_small(own.select("mark", "centre"), how), "mark", "left")
    side = lambda at: known.select("h", *[F.col(c).alias(f"{at}_{c}") for c in ("mark", "g", "n", "tail", "centre")])
    other = F.coalesce(F.col("a_centre") != F.col("b_centre"), F.lit(True))
    return side("a").join(side("b"), "h").where((F.col("a_mark") < F.col("b_mark")) & (F.col("a_g") != F.col("b_g")) & other & how.sizes("a_n", "b_n"))


def _full(marks: DataFrame, sets: DataFrame, plain: DataFrame, last, how: NearCopies) -> DataFrame:
    """Columns mark, words: the whole sets of these texts."""

    def whole(batch: pa.RecordBatch) -> list:
        return [batch.column(0), [shingles(t, how, last.value).tobytes() for t in batch.column(1).to_pylist()]]

    keys = settle(sets.join(marks, "mark").select("mark", F.col("f.key").alias("key")))
    texts = plain.select("key", "text").join(_small(keys, how), "key").select("mark", "text")
    return settle(map_batches(texts, whole, fields("mark bigint, words binary"), text=1).dropDuplicates(["mark"]))


def _confirmed(maybe: DataFrame, sets: DataFrame, plain: DataFrame, last, how: NearCopies) -> DataFrame:
    """Those of the pairs (a, b) that are near copies, by their whole sets."""

    def are(batch: pa.RecordBatch) -> list:
        both = zip(numbers(batch.column(2)), numbers(batch.column(3)), strict=True)
        keep = pa.array([bool(how.near(len(np.intersect1d(p, q, True)), len(p), len(q))) for p, q in both], pa.bool_())
        return [batch.column(k).filter(keep) for k in (0, 1)]

    full = _full(_either(maybe), sets, plain, last, how)
    pair = maybe.join(_ends(full, "a", "words"), "a").join(_ends(full, "b", "words"), "b").select("a", "b", "a_words", "b_words")
    return settle(map_batches(pair, are, fields("a bigint, b bigint")))
