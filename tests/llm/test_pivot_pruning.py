"""What pivot bounds skip where vectors lie in clusters, and rows that repeat."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from logloom.llm.pivot_search import PivotIndex, Space, top_k


def test_op2_bounds_skip_other_clusters():
    g = np.random.default_rng(1)
    centres = g.normal(0, 1, (16, 64))
    x = np.repeat(centres, 100, axis=0) + g.normal(0, 0.05, (1600, 64))
    v = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    space = Space(v[::100], np.zeros((16, 0)), float((v * v).sum(1).max()), True)
    space.cuts = np.stack([np.quantile(space.distances(v)[p * 100 : p * 100 + 100, p], np.arange(1, 8) / 8) for p in range(16)])
    cell, at = space.cells(v)
    space.ranges = np.array([[at[cell == c].min(), at[cell == c].max()] if (cell == c).any() else [np.inf, -np.inf] for c in range(128)])
    q = v[::20]
    scores = q @ v.T
    floor = np.sort(scores, axis=1)[:, -21]
    best = space.best_scores(q, space.ranges, np.arange(128) // 8)
    skipped = (best < floor[:, None])[:, cell]
    assert skipped.mean() > 0.85 and not (skipped & (scores > floor[:, None])).any()


def test_op2_repeated_rows_are_candidates_each(spark):
    g = np.random.default_rng(4)
    rows = [(i, g.integers(-3, 4, 5).astype(float).tolist()) for i in range(120)]
    rows += rows[20:60] + rows[20:30] + [(i, [2.0, 2.0, 2.0, 2.0, 2.0]) for i in range(120, 150)] * 2
    got = top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 20 == 0, index=PivotIndex(pivots=3, annuli=3, sample=50, block=8, query_block=2, salt=2)).collect()
    want = []
    v = [(i, np.floor(64 * np.array(x)).astype(np.int64)) for i, x in rows]
    for q in sorted({i for i, _ in v if i % 20 == 0}):
        own = next(x for i, x in v if i == q)
        best = sorted((-int(own @ x), i) for i, x in v if i != q)[:20]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == want
