"""The surface of a context against a walk over its events, one after the other."""

from __future__ import annotations

import random

from logloom.operators import context as C
from logloom.operators.context import alive_at_steps
from logloom.operators.graph import vetoed_components
from logloom.operators.surface import compactions, surface_nodes

EVENTS = "file string, seq bigint, kind string, cat string, tokens bigint, first bigint, last bigint, shadowed array<bigint>, extra int"


def walked(events):
    """Of one file: (seq, pos, gone) of each node, and what each compaction has freed."""
    surface, systems, out, freed, claim = [], [], {}, {}, None

    def remove(picked, by):
        for s in picked:
            out[s][1] = by
        return sum(tokens[s] for s in picked)

    tokens = {e[1]: e[4] or 0 for e in events}
    for _, seq, kind, _, own, first, last, shadowed, _ in sorted(events, key=lambda e: e[1]):
        if kind in ("compaction", "prune"):
            freed[seq] = own or 0
            if shadowed is not None:
                claim = (seq, shadowed)
        elif kind in ("node", "system"):
            held, claim = claim, None
            out[seq] = [seq, None]
            ranged = first is not None and last is not None
            if kind == "system":
                if ranged:
                    for group in (systems, surface):
                        picked = [s for s in group if first <= s <= last]
                        remove(picked, seq)
                        group[:] = [s for s in group if s not in picked]
                systems.append(seq)
            elif ranged and held and held[1]:
                picked = [s for s in surface if s in held[1]]
                freed[held[0]] = max(0, remove(picked, seq) - (own or 0))
                surface = [s for s in surface if s not in picked] + [seq]
            elif ranged and first in surface and last in surface and surface.index(first) <= surface.index(last):
                a, b = surface.index(first), surface.index(last)
                out[seq][0] = out[first][0]
                remove(surface[a : b + 1], seq)
                surface[a : b + 1] = [seq]
            else:
                surface.append(seq)
    return {s: tuple(v) for s, v in out.items()}, freed


def made(seed: int, files: int, longest: int):
    rng = random.Random(seed)
    rows = []
    for f in range(files):
        n = rng.randint(0, longest)
        for seq in range(n):
            kind = rng.choices(["node", "system", "compaction", "prune", "step/end", None], [12, 1, 1, 1, 1, 1])[0]
            first, last = (sorted(rng.randint(max(0, seq - 12), seq) for _ in "ab") if rng.random() < 0.4 else (None, None))
            if first is not None and rng.random() < 0.1:
                first, last = last, first
            shadowed = rng.choice([None, [], [rng.randint(0, n) for _ in range(4)]]) if kind in ("compaction", "prune") else None
            rows.append((f"f{f}", seq, kind, rng.choice(["user", "assistant"]), rng.choice([None, 3, 10]), first, last, shadowed, 0))
    return rows


def test_surface_is_that_of_a_walk(spark):
    rows = made(5, 60, 45)
    # One file with far more rows than the others, and rows that name no place.
    rows += [("hot", *r[1:]) for r in made(6, 1, 1200)] + [(None, 1, "node", "user", 1, None, None, None, 0), ("f0", None, "node", "user", 1, 0, 0, None, 0)]
    events = spark.createDataFrame(rows, EVENTS)
    nodes = surface_nodes(events)
    got, freed = {}, {}
    for r in nodes.collect():
        assert (r["file"], r["seq"]) not in got
        got[r["file"], r["seq"]] = (r["pos"], r["gone"])
    for r in compactions(events, nodes).collect():
        freed[r["file"], r["seq"]] = r["tokens"]
    expected, expected_freed = {}, {}
    for file in {r[0] for r in rows if r[0]}:
        places, tokens = walked([r for r in rows if r[0] == file and r[1] is not None])
        expected |= {(file, s): v for s, v in places.items()}
        expected_freed |= {(file, s): v for s, v in tokens.items()}
    assert got == expected and freed == expected_freed
    assert sum(g is not None for _, g in got.values()) > 200 and any(p != s for (_, s), (p, _) in got.items())


def test_alive_nodes_are_those_between_their_place_and_their_end(spark):
    nodes = [("f", 0, "user", 5, 2), ("f", 1, "assistant", 7, None), ("f", 2, "user", 1, None), ("f", 3, "assistant", 2, None)]
    got = C.alive_at_steps(spark.createDataFrame(nodes, "file string, seq bigint, cat string, tokens bigint, gone bigint")).collect()
    assert sorted(map(tuple, got)) == [("f", 1, 1, 5), ("f", 3, 2, 8)]


def test_no_events_give_no_nodes(spark):
    none = spark.createDataFrame([], EVENTS)
    assert surface_nodes(none).count() == 0 and compactions(none, surface_nodes(none)).count() == 0


def test_joins_that_grow_move_no_side_through_the_driver(spark):
    events = spark.createDataFrame([(f, i, "node", "user", 1, i - 3 if i % 4 == 3 else None, i - 2 if i % 4 == 3 else None, None) for f in range(3) for i in range(20)], "file long, seq long, kind string, cat string, tokens long, first long, last long, shadowed array<long>")
    nodes = surface_nodes(events)
    edges = spark.createDataFrame([(k, k // 2, k % 5 == 0) for k in range(1, 40)], "src long, dst long, vetoes boolean")
    for df in (nodes, compactions(events, nodes), alive_at_steps(nodes), vetoed_components(edges, edges.select("src", "dst"))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
