"""Inherited prefixes and undone nodes against walks written from the rule."""

from __future__ import annotations

import random

from logloom.operators import lineage as L


def own_by_walk(fork, parent):
    out, offset, inherits = [], 0, True
    for seq, p in enumerate(fork):
        if inherits and p in parent[offset:]:
            offset = parent.index(p, offset) + 1
            continue
        inherits = False
        out.append((seq, p))
    return out


def test_a_fork_inherits_what_it_finds_in_order(spark):
    r = random.Random(5)
    cases = [("BAX", "ABA"), ("", "AB"), ("AB", ""), ("AAAB", "ABAAB"), ("ABC", "ABC"), ("XAB", "AB")] + [("".join(r.choices("ABC", k=r.randint(0, 9))) + r.choice(["", "X"]) + "AB", "".join(r.choices("ABC", k=r.randint(0, 14)))) for _ in range(60)]
    forks = [(n, 1000 + n, s, p) for n, (f, _) in enumerate(cases) for s, p in enumerate(f)]
    parents = [(1000 + n, s, p) for n, (_, f) in enumerate(cases) for s, p in enumerate(f)]
    forks += [(5000, None, 0, "A"), (5001, 4999, 0, "A"), (5002, 1000, 0, None), (5002, 1000, 1, "A")]
    got = L.own_records(spark.createDataFrame(forks, "file long, parent long, seq long, print string"), spark.createDataFrame(parents, "file long, seq long, print string"))
    want = {(n, s, p) for n, (f, b) in enumerate(cases) for s, p in own_by_walk(f, list(b))} | {(5000, 0, "A"), (5001, 0, "A"), (5002, 0, None), (5002, 1, "A")}
    assert {tuple(x) for x in got.collect()} == want


def test_an_undo_drops_what_lies_from_its_bound_to_itself(spark):
    r = random.Random(6)
    rows, want = [], {}
    for file in range(20):
        undos = {s: r.randint(-2, s + 3) for s in range(30) if r.random() < 0.25}
        rows += [(file, s, "user", False, False, undos.get(s), False) for s in range(30)]
        want |= {(file, s): min((u for u, to in undos.items() if to <= s < u), default=None) for s in range(30)}
    got = L.context_intervals(spark.createDataFrame(rows, "file long, seq long, cat string, compacts boolean, prunes boolean, undoes_to long, kept boolean"))
    assert {(x["file"], x["seq"]): x["gone"] for x in got.collect()} == want
