"""Links of large leaves, found by a tree over all bits, and leaves dealt into runs."""

from __future__ import annotations

import numpy as np
import pytest

from logloom.llm.simhash_dedup import SimHash, _link_blocks, _link_leaf, near_links


def clusters(n: int, seed: int = 3) -> np.ndarray:
    g = np.random.default_rng(seed)
    base = g.integers(0, 1 << 63, n, np.int64).astype(np.uint64)
    flips = [sum(1 << int(x) for x in g.choice(64, g.integers(0, 5), replace=False)) for _ in range(3 * n)]
    return np.unique(np.repeat(base, 3) ^ np.array(flips, np.uint64))


def labels(points: np.ndarray, src: np.ndarray, dst: np.ndarray) -> dict:
    parent = {int(p): int(p) for p in points}

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in parent}


def test_op9_tree_of_a_large_leaf_equals_all_pairs():
    points = clusters(1200)
    how = SimHash(plain=1000)
    assert labels(points, *_link_leaf(points, points, how)) == labels(points, *_link_blocks(points, points, how.radius))
    half = points[::2]
    assert labels(points, *_link_leaf(half, points, how)) == labels(points, *_link_blocks(half, points, how.radius))


@pytest.mark.parametrize("how", [SimHash(leaf=400, block=40, share=1.0), SimHash(bands=2, leaf=400, block=40, share=1.0)])
def test_op9_runs_of_a_leaf_lose_no_link(spark, how):
    points = clusters(150)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    got = near_links(df, how).toPandas()
    src, dst = (got[c].to_numpy(np.int64).view(np.uint64) for c in ("src", "dst"))
    assert labels(points, src, dst) == labels(points, *_link_blocks(points, points, how.radius))
