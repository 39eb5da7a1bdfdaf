"""Operator 9, SimHash near-dedup: vantage-point trees over Hamming distance, exact to a given radius."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import as_row, fields, map_batches, table
from logloom.operators.graph import connected_components
from logloom.sources.shared import settle


@dataclass(frozen=True)
class SimHash:
    """Production parameters.

    shingle: words. radius: bits that may differ. bands: metrics that a tree is built for, each
    the Hamming distance over an equal part of the bits; two fingerprints within the radius are
    within radius // bands in at least one of them, so smaller balls are searched, and less of
    them crosses a border. With more bands than the radius has bits nothing crosses one, and a
    fingerprint goes to one leaf of each tree at every size of the input. leaf: fingerprints that
    a leaf holds on average. share, sample: of the fingerprints that the trees are built from on
    the driver, and how many of them about at most (8 bytes each); all are searched. block:
    fingerprints of a leaf that meet in one task about; larger leaves are dealt into runs. plain:
    comparisons of a task that need no tree of their own. seed: of the shingles' hashes.
    """

    shingle: int = 3
    radius: int = 3
    bands: int = 4
    leaf: int = 256
    share: float = 0.125
    sample: int = 100_000
    block: int = 65_536
    plain: int = 1 << 22
    seed: int = 42


def fingerprint(words: list[bytes], how: SimHash = SimHash()) -> int:
    """The 64 bits that are set in over half of the shingles' hashes; no words: zero."""
    n = len(words) - how.shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    digest, seed = xxhash.xxh64_intdigest, how.seed
    if n <= 1:
        return digest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    stop = (start + size)[how.shingle - 1 :].tolist()
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start[:n].tolist(), stop, strict=True)), np.uint64, n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", how: SimHash = SimHash(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns `row` and fp, the fingerprint as a signed 64-bit number."""

    def of(batch: pa.RecordBatch) -> list:
        found = np.array([fingerprint((t or "").encode("utf-8", "replace").lower().split(), how) for t in batch.column(1).to_pylist()], np.uint64)
        return [batch.column(0), pa.array(found.view(np.int64))]

    rows = as_row(docs, keep, F.col(text).cast("string").alias("text"))
    return map_batches(rows, of, T.StructType([rows.schema["row"], *fields("fp bigint").fields]), text=1)


class VantageTree:
    """A vantage-point tree over the bits of a mask, built from a sample.

    Each inner node has a vantage point and the median distance to it: points up to that lie
    inside, the others outside. A point's home is the leaf on its own path. A ball crosses to
    the other side where the distance of its centre, less or plus the radius, passes the median
    (triangle inequality), so `visits` gives every leaf that can hold a point of the ball.
    """

    def __init__(self, sample: np.ndarray, mask: int, radius: int, leaves: int, seed: int):
        self.mask, self.radius = np.uint64(mask), radius
        g = np.random.default_rng(seed)
        least = max(1, len(sample) // max(1, leaves))
        point, cut, child = [], [], []
        todo = [(sample, -1, 0)]
        self.leaves = 0
        while todo:
            points, parent, side = todo.pop()
            node = None
            if len(points) > least:
                # Of a few points, the one whose median ball is crossed by the fewest others.
                best = None
                for v in g.choice(points, min(8, len(points)), replace=False):
                    d = self._distance(points, v)
                    mid = int(np.median(d))
                    for m in (mid - 1, mid, mid + 1):
                        inside = int((d <= m).sum())
                        if 0 < inside < len(points):
                            crossed = int((np.abs(d - m - 0.5) < radius).sum()) + abs(2 * inside - len(points)) / 2
                            if best is None or crossed < best[0]:
                                best = crossed, v, m, d <= m
                if best is not None:
                    node = len(point)
                    point.append(best[1])
                    cut.append(best[2])
                    child.append([0, 0])
                    todo += [(points[best[3]], node, 0), (points[~best[3]], node, 1)]
            if node is None:
                self.leaves += 1
                node = -self.leaves  # leaf k is -k - 1
            if parent >= 0:
                child[parent][side] = node
        self.point, self.cut, self.child = np.array(point, np.uint64), np.array(cut, np.int64), np.array(child, np.int64).reshape(-1, 2)

    def _distance(self, a: np.ndarray, b) -> np.ndarray:
        return np.bitwise_count((a ^ b) & self.mask).astype(np.int64)

    def visits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of points, the leaves that their balls reach, and whether that is their home."""
        index = np.arange(len(points))
        node = np.zeros(len(points), np.int64) if len(self.point) else np.full(len(points), -1)
        home = np.ones(len(points), bool)
        done = []
        while len(index):
            leaf = node < 0
            if leaf.any():
                done.append((index[leaf], -node[leaf] - 1, home[leaf]))
                index, node, home = index[~leaf], node[~leaf], home[~leaf]
                continue
            d, cut = self._distance(points[index], self.point[node]), self.cut[node]
            into, out = d - self.radius <= cut, d + self.radius > cut
            index, node, home = (
                np.concatenate([index[into], index[out]]), np.concatenate([self.child[node[into], 0], self.child[node[out], 1]]),
                np.concatenate([(home & (d <= cut))[into], (home & (d > cut))[out]]),
            )
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def _trees(sample: np.ndarray, total: int, how: SimHash) -> list[tuple[VantageTree, np.ndarray]]:
    """A tree for each band, and into how many runs the rows of each leaf are dealt."""
    width = 64 // how.bands
    made = []
    for band in range(how.bands):
        bits = 64 - width * (how.bands - 1) if band == how.bands - 1 else width
        tree = VantageTree(sample, ((1 << bits) - 1) << (width * band), how.radius // how.bands, max(1, min(total // how.leaf, len(sample) // 4)), how.seed + band)
        expected = np.bincount(tree.visits(sample)[1], minlength=tree.leaves) * (total / max(1, len(sample)))
        made.append((tree, np.maximum(1, np.ceil(expected / how.block)).astype(np.int64)))
    return made


def _link_blocks(homes: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between homes and others: pairs (point, smaller point).

    Links themselves are not emitted, so a group of n copies gives n - 1 pairs, not n squared.
    """
    points = np.unique(np.concatenate([homes, others]))
    parent = np.arange(len(points))
    at_home, at_other = np.searchsorted(points, homes), np.searchsorted(points, others)
    step = max(1, (1 << 20) // max(1, len(others)))
    for k in range(0, len(homes), step):
        near = np.bitwise_count(homes[k : k + step, None] ^ others[None]) <= radius
        for i in np.flatnonzero(near.sum(1)):
            both = np.append(at_other[near[i]], at_home[k + i])
            if (both == both[0]).all():
                continue
            while True:
                up = parent[both]
                if (parent[up] == up).all():
                    break
                parent[both] = parent[up]
            parent[up] = up.min()
    while (parent[parent] != parent).any():
        parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(len(points)))
    return points[moved], points[parent[moved]]


def _link_leaf(homes: np.ndarray, points: np.ndarray, how: SimHash) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between homes and points; many are searched by a tree over all bits."""
    if len(homes) * len(points) <= how.plain:
        return _link_blocks(homes, points, how.radius)
    tree = VantageTree(homes, (1 << 64) - 1, how.radius, len(homes) // 64, how.seed)
    index, leaf, home = tree.visits(homes)
    order = np.argsort(leaf[home], kind="stable")
    own, edges = homes[index[home][order]], np.searchsorted(leaf[home][order], np.arange(tree.leaves + 1))
    src, dst = [], []
    for k in range(0, len(points), 1 << 13):
        part = points[k : k + (1 << 13)]
        index, leaf, _ = tree.visits(part)
        order = np.argsort(leaf, kind="stable")
        index, leaf = index[order], leaf[order]
        cuts = np.searchsorted(leaf, np.arange(tree.leaves + 1))
        for n in np.flatnonzero(np.diff(cuts)):
            s, d = _link_blocks(own[edges[n] : edges[n + 1]], part[index[cuts[n] : cuts[n + 1]]], how.radius)
            src.append(s)
            dst.append(d)
    return np.concatenate(src), np.concatenate(dst)


def near_links(distinct: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """Columns src, dst: links that join exactly the fingerprints that chains of near pairs join.

    distinct has fp, each value once. Every fingerprint goes to its home leaf and, as a visitor,
    to the leaves that its ball reaches; the homes of a leaf meet all its points in one task. A
    leaf that holds many points is dealt into runs, and every two runs of it meet in a task of
    their own, so that no task gathers a whole one.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    rate = min(how.share, how.sample / max(1, total))
    chosen = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(rate * (1 << 20))).toPandas()["fp"].to_numpy(np.int64)
    trees = spark.sparkContext.broadcast(_trees(np.sort(chosen).view(np.uint64), total, how))

    def route(batch: pa.RecordBatch) -> list:
        points = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        out: list[list] = [[] for _ in range(5)]
        for band, (tree, runs) in enumerate(trees.value):
            index, leaf, home = tree.visits(points)
            of_leaf = runs[leaf]
            run = ((points[index] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % of_leaf
            at = np.repeat(np.arange(len(index)), of_leaf)  # once for each run that its own run meets
            other = np.arange(len(at)) - np.repeat(np.cumsum(of_leaf) - of_leaf, of_leaf)
            for o, v in zip(out, (leaf[at] * how.bands + band, np.minimum(run[at], other), np.maximum(run[at], other), points[index[at]].view(np.int64), home[at]), strict=True):
                o.append(v)
        return [pa.array(np.concatenate(x)) for x in out]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by leaf and runs; each group is linked when it ends."""
        key, fps, homes = None, [], []

        def linked() -> pa.RecordBatch:
            fp, home = np.concatenate(fps).astype(np.int64).view(np.uint64), np.concatenate(homes).astype(bool)
            pairs = _link_leaf(fp[home], fp, how) if home.any() else (np.zeros(0, np.uint64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in pairs], names=["src", "dst"])

        for batch in batches:
            *keys, fp, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            edges = [0, *(np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1).tolist(), len(fp)] if len(fp) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = tuple(int(k[a]) for k in keys)
                if key is not None and own != key:
                    yield linked()
                    fps, homes = [], []
                key = own
                fps.append(fp[a:b])
                homes.append(home[a:b])
        if fps:
            yield linked()

    routed = map_batches(distinct.select("fp"), route, fields("leaf bigint, a bigint, b bigint, fp bigint, home boolean"))
    return routed.repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b").mapInArrow(link, fields("src bigint, dst bigint")).distinct()


def _rows(docs: DataFrame, text: str, doc_id: str, how: SimHash, keep: tuple[str, ...] | None) -> DataFrame:
    return settle(fingerprints(docs, text, how, keep if keep is None else tuple(dict.fromkeys((*keep, doc_id)))))


def _groups(rows: DataFrame, doc_id: str, how: SimHash) -> DataFrame:
    """Columns fp, least and group, one row for each fingerprint: its smallest id, its group's smallest fingerprint."""
    distinct = settle(rows.groupBy("fp").agg(F.min(f"row.`{doc_id}`").alias("least")))
    member = connected_components(near_links(distinct, how))
    return settle(distinct.join(member, F.col("fp") == F.col("vertex"), "left").select("fp", "least", F.coalesce("component", "fp").alias("group")))


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", how: SimHash = SimHash(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns `row`, fp and component_id, the smallest doc_id of the document's group.

    A group is what chains of fingerprints of at most `radius` differing bits join; equal
    fingerprints are joined without being compared. A null text counts as empty; documents
    without words have fingerprint zero and are joined like any other. Null ids are never the
    smallest; a group of nothing else has a null component_id. Repeated rows fall into one
    group. An empty table gives an empty result.
    """
    rows = _rows(docs, text, doc_id, how, keep)
    groups = _groups(rows, doc_id, how)
    least = groups.groupBy("group").agg(F.min("least").alias("component_id"))
    classes = settle(groups.join(least, "group").select("fp", "component_id"))
    return rows.join(classes, "fp").select("row", "fp", "component_id")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def first_of_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", how: SimHash = SimHash()) -> DataFrame:
    """The documents, but of each group of near copies only that of the smallest id.

    Exactly one row of each group stays: of repeated rows with that id, and of the rows of a
    group without ids, one of the smallest fingerprint. Texts are moved once, to meet the ids
    and hashes that stay; only those and fingerprints are written down before.
    """
    own_hash, first_id, first_hash, rank = (_free(docs, name) for name in ("own_hash", "first_id", "first_hash", "first_rank"))
    tagged = docs.withColumn(own_hash, F.xxhash64(F.col(text).cast("string")))
    rows = _rows(tagged, text, doc_id, how, (doc_id, own_hash))
    groups = _groups(rows, doc_id, how).select("fp", "group")
    each = rows.select("fp", F.col(f"row.`{doc_id}`").alias("id"), F.col(f"row.`{own_hash}`").alias("hash"))
    least = each.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), "id", "fp", "hash")).alias("f"))
    first = least.join(groups, "fp").groupBy("group").agg(F.min("f").alias("f"))
    first = settle(first.select(F.col("f.id").alias(first_id), F.col("f.hash").alias(first_hash)))
    own = tagged.join(first, (F.col(own_hash) == F.col(first_hash)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(first_id)), "left_semi")
    place = F.row_number().over(Window.partitionBy(own_hash, f"`{doc_id}`").orderBy(own_hash))
    return own.withColumn(rank, place).where(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = near_dedup(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return grouped.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
