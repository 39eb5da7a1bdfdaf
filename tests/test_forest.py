"""Forests of records: paths, contexts, restored surfaces and nested order, against plain walks."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.operators import forest as G
from logloom.operators.scans import running_sums


def walk(parents, leaf):
    path = []
    while leaf in parents and leaf not in path:
        path.append(leaf)
        leaf = parents[leaf]
    return path


def random_forest(r, n, cycles=0.0):
    ids = list(range(n))
    r.shuffle(ids)
    parents = {}
    for k, i in enumerate(ids):
        parents[i] = None if k == 0 or r.random() < 0.05 else r.choice(ids[max(0, k - r.choice([1, 3, 50])) : k])
    for i in ids:
        if r.random() < cycles:
            parents[i] = r.choice([*ids, 10_000 + i])
    return parents


def test_paths_and_contexts_equal_a_walk(spark):
    r = random.Random(1)
    records, want_path, want_context, want_route = [], set(), set(), {}
    for file in range(30):
        parents = random_forest(r, r.randint(1, 60), 0.05 if file % 3 == 0 else 0)
        facts = {i: (r.random() < 0.08, r.choice([*parents, None]), r.random() < 0.2, r.choice([None, None, "p", "q"]), r.choice([None, None, "m", "n"]), r.choice([None, None, "t"])) for i in parents}
        leaf = r.choice(list(parents))
        records += [(file, i, p, *facts[i], i == leaf) for i, p in parents.items()]
        path = walk(parents, leaf)
        want_path |= {(file, i, k) for k, i in enumerate(path)}
        path = path[::-1]
        at = max((k for k, i in enumerate(path) if facts[i][0]), default=None)
        if at is None:
            seen = path
        else:
            kept = path.index(facts[path[at]][1]) if facts[path[at]][1] in path[:at] else at
            seen = [path[at], *[i for i in path[kept:at] if not facts[i][2]], *path[at + 1 :]]
        want_context |= {(file, k, i) for k, i in enumerate(seen)}
        want_route[file] = tuple(next((facts[i][c] for i in reversed(path) if facts[i][c] is not None), None) for c in (3, 4, 5))
    df = spark.createDataFrame(records, "file long, id long, parent long, compaction boolean, first_kept long, system boolean, provider string, model string, thinking string, leaf boolean")
    leaves = df.where("leaf").select("file", "id").union(spark.createDataFrame([(0, 999_999), (77, 1)], "file long, id long").where("file = 77"))
    assert {tuple(x) for x in G.paths_to(df, leaves).collect()} == want_path
    by_file = {}
    for x in sorted(G.context_entries(df, leaves).collect(), key=lambda x: x["place"]):
        by_file.setdefault(x["file"], []).append(x["id"])
    assert {(f, k, i) for f, ids in by_file.items() for k, i in enumerate(ids)} == want_context
    assert {x["file"]: tuple(x)[1:] for x in G.route_at(df, leaves).collect()} == want_route


def test_restored_surfaces_equal_replaying_the_events(spark):
    r = random.Random(2)
    rows, want = [], set()
    for file in range(40):
        seqs = sorted(r.sample(range(100), r.randint(1, 40)))
        states, now = {}, []
        for s in seqs:
            back = r.randint(-3, 105) if r.random() < 0.3 else None
            rows.append((file, s, back))
            if back is None:
                now = [*now, s]
            else:
                reached = [x for x in states if x <= min(back, s - 1)]
                now = states[max(reached)] if reached else []
            states[s] = now
        want |= {(file, s) for s in now}
    assert {tuple(x) for x in G.surface_after_restores(spark.createDataFrame(rows, "file long, seq long, restores long")).collect()} == want


def nested_by_walk(parents, order):
    known = {i: p if p in parents and p != i else None for i, p in parents.items()}
    for i in parents:  # the records of a cycle are roots
        path = walk(known, i)
        if known[path[-1]] is not None and known[path[-1]] == i:
            for x in path:
                known[x] = ("cut", known[x])
    known = {i: None if isinstance(p, tuple) else p for i, p in known.items()}
    children = {}
    for i, p in known.items():
        children.setdefault(p, []).append(i)
    out, place = {}, 0
    todo = [(i, i, 0) for i in sorted(children.get(None, []), key=lambda i: (order[i], i), reverse=True)]
    while todo:
        i, root, depth = todo.pop()
        out[i] = [known[i], root, depth, 1, place]
        place += 1
        todo += [(c, root, depth + 1) for c in sorted(children.get(i, []), key=lambda i: (order[i], i), reverse=True)]
    for i in sorted(out, key=lambda i: -out[i][2]):
        if known[i] is not None:
            out[known[i]][3] += out[i][3]
    return out


@pytest.mark.parametrize("cycles", [0.0, 0.1])
def test_nested_order_and_subtrees_equal_a_walk(spark, cycles):
    r = random.Random(3)
    rows, want = [], set()
    for file in range(12):
        parents = random_forest(r, r.randint(1, 80), cycles)
        order = {i: r.choice([None, 1, 2, 3]) for i in parents}
        rows += [(file, i, p, order[i]) for i, p in parents.items()]
        want |= {(file, i, *v) for i, v in nested_by_walk(parents, {i: -1 if o is None else o for i, o in order.items()}).items()}
    got = G.nested(spark.createDataFrame(rows, "file long, id long, parent long, started long"), ["started"])
    assert {tuple(x) for x in got.select("file", "id", "parent", "root", "depth", "size", "place").collect()} == want


def test_nested_with_many_siblings_and_a_deep_chain(spark):
    wide = spark.range(100_000).select(F.lit(1).alias("file"), F.col("id"), F.when(F.col("id") > 0, F.lit(0)).alias("parent"), (-F.col("id")).alias("started"))
    deep = spark.range(51).select(F.lit(2).alias("file"), F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).alias("started"))
    got = G.nested(wide.union(deep), ["started"])
    assert got.where("file = 1 AND id > 0 AND (place <> 100000 - id OR size <> 1 OR depth <> 1 OR root <> 0)").count() == 0 and got.where("file = 1").count() == 100_000
    assert [tuple(x) for x in got.where("file = 2").orderBy("id").select("depth", "place", "size").collect()] == [(k, k, 51 - k) for k in range(51)]


def test_family_pages_at_any_depth(spark):
    parents = {0: None, 1: 0, 2: 1, 3: 2, 4: 0, 10: None, 11: 10}
    walk = G.nested(spark.createDataFrame([(1, i, p, -i) for i, p in parents.items()], "file long, id long, parent long, since long"), ["since"])
    got = {(x["root"], x["place"], x["id"], x["more"]) for x in G.family_page(walk, 3).collect()}
    assert got == {(10, 0, 10, 0), (10, 1, 11, 0), (0, 0, 0, 2), (0, 1, 4, 2), (0, 2, 1, 2)}


def test_running_sums_span_tasks(spark):
    rows = [(k % 3 if k % 7 else None, k, k * 3 % 11 if k % 5 else None) for k in range(3000)]
    got = {(x["g"], x["o"]): x["s"] for x in running_sums(spark.createDataFrame(rows, "g int, o int, v int"), ["g"], ["o"], {"s": F.col("v")}).collect()}
    so_far = {}
    for g, o, v in rows:
        so_far[g] = so_far.get(g, 0) + (v or 0)
        assert got[g, o] == so_far[g]


def test_nothing_gives_nothing(spark):
    none = spark.createDataFrame([], "file long, id long, parent long, compaction boolean, first_kept long, system boolean, at long, seq long, restores long")
    assert G.nested(none, ["at"]).count() == G.paths_to(none, none.select("file", "id")).count() == G.context_entries(none, G.last_records(none)).count() == G.surface_after_restores(none).count() == 0
    twice = spark.createDataFrame([(1, 1, None, 1, "x"), (1, 1, None, 2, "y"), (None, 1, None, 1, "z"), (1, None, None, 1, "z")], "file long, id long, parent long, at long, t string")
    assert [tuple(x) for x in G.distinct_records(twice).select("file", "id", "t").collect()] == [(1, 1, "y")]


@pytest.mark.parametrize("in_task", [1, 40, 1000])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_nested_order_is_the_same_in_tasks_and_by_joins(spark, monkeypatch, in_task, kind):
    r = random.Random(7)
    rows, want = [], set()
    for file in range(8):
        parents = random_forest(r, r.randint(1, 80), 0.1)
        order = {i: r.choice([None, 1, 2, 3]) for i in parents}
        own = {i: i if kind == "long" else f"{i:03d}" for i in parents}
        rows += [(f"f{file}", own[i], None if p is None else own.get(p, 7777 if kind == "long" else "none"), order[i]) for i, p in parents.items()]
        want |= {(f"f{file}", own[i], own.get(v[0]), own[v[1]], *v[2:]) for i, v in nested_by_walk(parents, {i: -1 if o is None else o for i, o in order.items()}).items()}
    joined, inner = [], G._nested_by_joins
    monkeypatch.setattr(G, "_nested_by_joins", lambda records, order: joined.append(records.select("file").distinct().count()) or inner(records, order))
    got = G.nested(spark.createDataFrame(rows, f"file string, id {kind}, parent {kind}, started long"), ["started"], in_task)
    assert {tuple(x) for x in got.select("file", "id", "parent", "root", "depth", "size", "place").collect()} == want
    large = sum(1 for n in Counter(f for f, *_ in rows).values() if n > in_task)
    assert joined == ([large] if large else [])
