"""What the mix takes is what its splitting tree has dealt."""

from __future__ import annotations

from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm.source_mix import Mix, hypergeometric, mix_sources, op10_source_mix, splitting_tree
from tests.llm.rows import documents, words


def test_op10_tree_sums_and_leaves(spark):
    quotas = spark.createDataFrame([(1, 103), (2, 40), (3, 0), (4, 7)], "rank int, n bigint")
    trees = {r["rank"]: r["tree"] for r in splitting_tree(quotas, 16).collect()}
    assert {k: t[0] for k, t in trees.items()} == {1: 103, 2: 40, 3: 0, 4: 7}
    for t in trees.values():
        assert len(t) == 31 and all(t[k - 1] == t[2 * k - 1] + t[2 * k] and t[k - 1] >= 0 for k in range(1, 16))
    per_leaf = [sum(t[15 + k] for t in trees.values()) for k in range(16)]
    assert sum(per_leaf) == 150 and max(per_leaf) - min(per_leaf) <= 1


def test_op10_draws_follow_the_hypergeometric_law(spark):
    drawn = spark.range(20_000).select(hypergeometric(F.lit(20).cast("bigint"), F.lit(8).cast("bigint"), F.lit(10).cast("bigint"), (F.col("id") + 0.5) / 20_000).alias("k")).groupBy("k").count().collect()
    got = {r["k"]: r["count"] / 20_000 for r in drawn}
    assert got == pytest.approx({k: comb(8, k) * comb(12, 10 - k) / comb(20, 10) for k in range(9)}, abs=2e-4)


def test_op10_takes_what_the_tree_deals_to_each_shard(spark):
    rows = [(i, words(1 + i % 23, i), "en", "abc"[i % 7 % 3], 1) for i in range(1500)]
    mix = Mix(shards=8, block_docs=4, fan=8)
    got = mix_sources(documents(spark, rows), mix=mix, keep=("doc_id", "source")).collect()
    shards: dict = {s: Counter() for s in "abc"}
    for r in got:
        for p in r["placements"]:
            shards[r["row"]["source"]][p["shard"]] += r["size"]
    for s in "abc":
        taken, target = sum(shards[s].values()), next(r["target"] for r in got if r["row"]["source"] == s)
        assert abs(taken - target) <= 0.001 * target
        assert set(shards[s]) == set(range(8)) and np.std(list(shards[s].values())) < 0.35 * taken / 8
    positions = [(r["row"]["doc_id"], p["copy"]) for r in got for p in r["placements"]]
    assert len(positions) == len(set(positions))


def test_op10_is_near_its_targets_at_the_smallest_scale(spark):
    got = op10_source_mix(spark, "/root/testdata/sf0.001")
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source")
    for r in got.join(source, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= max(2, 0.01 * r["target"]), r


def test_op10_shards_follow_the_text():
    mix = Mix(shard_bytes=100, tree_shards=16)
    assert [mix.dealt(b) for b in (0, 60, 130, 1000, 20_000)] == [(1, 1), (1, 1), (2, 1), (16, 1), (16, 19)]
