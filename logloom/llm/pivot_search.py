"""Operator 2, exact top-k search by inner product: an index of pivot distances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.common import fields, map_batches, table
from logloom.sources.shared import settle


@dataclass(frozen=True)
class PivotIndex:
    """Production parameters.

    k: results of a query. pivots, annuli: of the index; sample: vectors that they are chosen
    from on the driver (all are indexed). first: nearest annuli that a query searches before
    bounds are known. block, query_block: vectors that are scored together. salt: queries of an
    annulus that meet a run of its blocks in one task about.
    """

    k: int = 20
    pivots: int = 16
    annuli: int = 8
    sample: int = 2048
    first: int = 1
    block: int = 1024
    query_block: int = 512
    salt: int = 65_536


class Space:
    """Vectors of one length, lifted so that the nearest is the one of the greatest inner product.

    With M the greatest norm, x becomes (x, sqrt(M² - |x|²)) and a query q becomes (q, 0); then
    the squared distance is |q|² + M² - 2 q·x. Distances are rounded, so every bound is widened
    by a relative margin before it excludes anything; scores themselves are exact integers.
    """

    def __init__(self, pivots: np.ndarray, cuts: np.ndarray, greatest: float, exact: bool, ranges: np.ndarray | None = None, runs: np.ndarray | None = None):
        self.pivots, self.cuts, self.greatest, self.exact, self.ranges, self.runs, self.salts = pivots, cuts, greatest, exact, ranges, runs, 1

    @staticmethod
    def matrix(rows: list) -> np.ndarray:
        return np.array(rows, np.int64).reshape(len(rows), -1)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.sqrt(np.maximum(self.greatest - (x * x).sum(1), 0))

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Of each row to each pivot."""
        x, p = x.astype(np.float64), self.pivots.astype(np.float64)
        own = np.zeros(len(x)) if query else self.lifted(x)
        square = (x * x).sum(1)[:, None] + own[:, None] ** 2 + self.greatest - 2 * (x @ p.T + own[:, None] * self.lifted(self.pivots)[None])
        return np.sqrt(np.maximum(square, 0))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The annulus of each row around its nearest pivot, and the distance to that pivot."""
        d = self.distances(x)
        near = d.argmin(1)
        at = d[np.arange(len(x)), near]
        ring = (at[:, None] > self.cuts[near]).sum(1)
        return near * (self.cuts.shape[1] + 1) + ring, at

    def best_scores(self, q: np.ndarray, ranges: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        """The greatest score that each query can have in each annulus, by the triangle inequality."""
        d = self.distances(q, query=True)[:, pivot]
        low, high = ranges[:, 0][None], ranges[:, 1][None]
        margin = 1e-6 * (1 + d + high)
        bound = np.maximum(0, np.maximum(low - d, d - high) - margin)
        f = q.astype(np.float64)
        return np.where(np.isfinite(low), ((f * f).sum(1)[:, None] + self.greatest - bound**2) / 2 * (1 + 1e-9) + 1, -np.inf)

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Exact inner products; beyond 64 bits they stop at the greatest or smallest number."""
        if self.exact:
            return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        whole = q.astype(object) @ x.astype(object).T
        return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Columns vec_id, v (floor of 64 times each component) and dim, of the rows that take part."""
    x = F.col(embedding)
    sound = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * 64).cast("bigint"))
    return vectors.where(sound).select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).withColumn("dim", F.size("v"))


def top_k(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", index: PivotIndex = PivotIndex()) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the k greatest inner products of each query.

    Queries are the rows where the condition on vec_id holds; candidates are all rows but those
    of the query's own id. Equal scores: the smaller id first. Rows whose vector or id is null,
    or that hold a null or non-finite component, take no part; vectors of other lengths than the
    query's are no candidates. Repeated rows are candidates each on its own, and search once; an
    id of several vectors gives each of them as a candidate and searches with each. Fewer
    candidates than k give all.
    Scores beyond 64 bits stop at the greatest or smallest number. An empty table gives an empty
    result.
    """
    rows = settle(whole_vectors(vectors, vec_id, embedding))
    # Of equal vectors only the k + 1 least ids (one may be the query's own), and k rows of each,
    # can be among a query's results. The limits work within each task before rows meet.
    ids = Window.partitionBy("v").orderBy("vec_id")
    copies = rows.groupBy("v", "vec_id", "dim").agg(F.count(F.lit(1)).alias("copies"))
    near = copies.withColumn("n", F.row_number().over(ids)).where(F.col("n") <= index.k + 1)
    candidates = settle(near.select("vec_id", "v", "dim", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(index.k)))).alias("copy")).drop("copy"))
    asking = rows.where(queries).distinct()
    dims = [r["dim"] for r in asking.select("dim").distinct().collect()]
    if not dims:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    found = [_search(candidates.where(F.col("dim") == d), asking.where(F.col("dim") == d), index) for d in sorted(dims)]
    return reduce(DataFrame.unionByName, found)


def _space(candidates: DataFrame, index: PivotIndex) -> Space:
    """Pivots far from one another and annuli of equal shares, from a sample of the candidates."""
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    n, greatest, largest = candidates.agg(F.count(F.lit(1)), F.max(square), F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))))).first()
    drawn = candidates.orderBy(F.xxhash64("vec_id", "v")).limit(index.sample).toPandas()
    sample = Space.matrix(drawn["v"].tolist())
    exact = float(largest or 0) ** 2 * max(1, sample.shape[1]) < 2**53
    space = Space(sample[:1], np.zeros((1, 0)), float(greatest or 0), exact)
    nearest = space.distances(sample)[:, 0]
    chosen = [0]
    while len(chosen) < min(index.pivots, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        space.pivots = sample[chosen]
        nearest = np.minimum(nearest, space.distances(sample)[:, -1])
    d = space.distances(sample)
    near = d.argmin(1)
    space.cuts = np.stack([np.quantile(d[near == p, p] if (near == p).any() else d[:, p], np.arange(1, index.annuli) / index.annuli) for p in range(len(chosen))])
    cell, _ = space.cells(sample)
    share = np.bincount(cell, minlength=len(chosen) * index.annuli) * (n / len(sample))
    space.runs = np.maximum(1, np.ceil(share / (4 * index.block))).astype(np.int64)
    return space


def _blocks(candidates: DataFrame, space: Space, index: PivotIndex) -> DataFrame:
    """Rows cell, low, high, ids, vectors: a block's vectors lie between two distances from their pivot.

    Rows are dealt by annulus and, where the sample says that one is large, by several runs of
    it; within a run they are sorted by distance and cut into blocks.
    """
    sent = candidates.sparkSession.sparkContext.broadcast(space)

    def place(batch: pa.RecordBatch) -> list:
        s, x = sent.value, Space.matrix(batch.column(1).to_pylist())
        cell, at = s.cells(x)
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        run = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % s.runs[cell]
        return [pa.array(cell), pa.array(run), pa.array(at), pa.array(ids), [r.tobytes() for r in x]]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, ids, vectors = None, [], [], []

        def block() -> pa.RecordBatch:
            values = ([key[0]], pa.int64()), ([key[1]], pa.int64()), ([at[0]], pa.float64()), ([at[-1]], pa.float64()), ([np.array(ids, np.int64).tobytes()], pa.binary()), ([b"".join(vectors)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in values], names=["cell", "run", "low", "high", "ids", "vectors"])

        for batch in batches:
            for c, r, d, i, v in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if key is not None and (key != (c, r) or len(ids) >= index.block):
                    yield block()
                    at, ids, vectors = [], [], []
                key = c, r
                at.append(d)
                ids.append(i)
                vectors.append(v)
        if ids:
            yield block()

    placed = map_batches(candidates.select("vec_id", "v"), place, fields("cell bigint, run bigint, at double, vec_id bigint, vector binary"))
    return settle(placed.repartition("cell", "run").sortWithinPartitions("cell", "run", "at").mapInArrow(pack, fields("cell bigint, run bigint, low double, high double, ids binary, vectors binary")))


def _ask(asking: DataFrame, space: Space, index: PivotIndex, first: bool) -> DataFrame:
    """Rows cell, ids, vectors, floors: the queries that search an annulus, in blocks.

    asking has vec_id, v and (after the first search) floor, the k-th score known so far. An
    annulus is searched if the greatest score possible in it reaches the floor. The first search
    goes to the annuli of the greatest possible scores only, the second to the others.
    """
    sent = asking.sparkSession.sparkContext.broadcast(space)

    def ask(batch: pa.RecordBatch) -> list:
        s = sent.value
        ids, x, floor = batch.column(0).to_numpy(zero_copy_only=False), Space.matrix(batch.column(1).to_pylist()), batch.column(2).to_numpy(zero_copy_only=False)
        cells = np.flatnonzero(np.isfinite(s.ranges[:, 0]))
        out: list[list] = [[], [], [], []]
        for k in range(0, len(x), index.query_block):
            part = slice(k, k + index.query_block)
            best = s.best_scores(x[part], s.ranges[cells], cells // (s.cuts.shape[1] + 1))
            rank = (-best).argsort(1, kind="stable").argsort(1, kind="stable")
            goes = (rank < index.first) if first else (rank >= index.first) & (best >= floor[part, None])
            for c in np.flatnonzero(goes.any(0)):
                g = goes[:, c]
                for o, v in zip(out, (int(cells[c]), ids[part][g].tobytes(), x[part][g].tobytes(), floor[part][g].astype(np.int64).tobytes()), strict=True):
                    o.append(v)
        return out

    return map_batches(asking.select("vec_id", "v", "floor"), ask, fields("cell bigint, ids binary, vectors binary, floors binary"))


def _scored(asked: DataFrame, blocks: DataFrame, space: Space, index: PivotIndex) -> DataFrame:
    """Columns query_id, query (a hash of its vector), vec_id, score: of each block the k best of a query."""
    sent = blocks.sparkSession.sparkContext.broadcast(space)
    dim = space.pivots.shape[1]
    # A run of an annulus meets a share of the queries at a time: keys are as many as tasks need, at any size.
    salts, runs = space.salts, F.element_at(F.array(*[F.lit(int(r)) for r in space.runs]), (F.col("cell") + 1).cast("int"))
    sides = asked.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), runs.cast("bigint") - 1)).alias("run"), F.pmod(F.xxhash64("ids"), F.lit(salts)).alias("salt"))
    others = blocks.select("cell", "run", "low", "high", F.col("ids").alias("own"), F.col("vectors").alias("others"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))
    met = sides.join(others, ["cell", "run", "salt"]).select("cell", "ids", "vectors", "floors", "low", "high", "own", "others")

    def score(batch: pa.RecordBatch) -> list:
        s = sent.value
        out: list[list] = [[np.zeros(0, np.int64)] for _ in range(4)]
        for cell, ids, vectors, floors, low, high, own, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            q_ids, floor, x_ids = np.frombuffer(ids, np.int64), np.frombuffer(floors, np.int64), np.frombuffer(own, np.int64)
            q, x = np.frombuffer(vectors, np.int64).reshape(len(q_ids), dim), np.frombuffer(others, np.int64).reshape(len(x_ids), dim)
            pivot = np.array([cell // (s.cuts.shape[1] + 1)])
            open_ = np.flatnonzero(s.best_scores(q, np.array([[low, high]]), pivot)[:, 0] >= floor)
            if not len(open_):
                continue
            got = s.scores(q[open_], x)
            fine = (got >= floor[open_, None]) & (x_ids[None] != q_ids[open_, None])
            for i in np.flatnonzero(fine.any(1)):
                at = np.flatnonzero(fine[i])
                if len(at) > index.k:
                    at = at[np.lexsort((x_ids[at], -got[i, at]))[: index.k]]
                for o, v in zip(out, (np.full(len(at), q_ids[open_[i]]), np.full(len(at), _hash(q[open_[i]])), x_ids[at], got[i, at]), strict=True):
                    o.append(v)
        return [pa.array(np.concatenate(o)) for o in out]

    return map_batches(met, score, fields("query_id bigint, query bigint, vec_id bigint, score bigint"))


def _hash(v: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(v.tobytes())).astype(np.int64))


def _search(candidates: DataFrame, asking: DataFrame, index: PivotIndex) -> DataFrame:
    space = _space(candidates, index)
    space.salts = max(1, -(-asking.count() // index.salt))
    blocks = _blocks(candidates, space, index)
    ranges = np.full((len(space.pivots) * index.annuli, 2), [np.inf, -np.inf])
    for r in blocks.groupBy("cell").agg(F.min("low"), F.max("high")).collect():  # one row for each annulus
        ranges[r[0]] = r[1], r[2]
    space.ranges = ranges
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    least = -(1 << 63)
    near = _scored(_ask(asking.withColumn("floor", F.lit(least)), space, index, True), blocks, space, index)
    near = settle(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= index.k))
    floors = near.where(F.col("rank") == index.k).groupBy("query_id").agg(F.min("score").alias("floor"))
    bounded = asking.join(floors, asking["vec_id"] == floors["query_id"], "left").select("vec_id", "v", F.coalesce("floor", F.lit(least)).alias("floor"))
    far = _scored(_ask(bounded, space, index, False), blocks, space, index)
    every = near.drop("rank").unionByName(far)
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= index.k).select("query_id", "rank", "vec_id", "score")


def op2_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP2_ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM (SELECT DISTINCT vec_id, e FROM v) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""
