"""The pipeline's near-duplicate stage against comparing all pairs."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from logloom.llm import near_copies
from tests.llm.rows import awkward, words


def near_groups(rows, k=5):
    """Ids that stay: the smallest of each group that chains of 5-word Jaccard 0.8 or more join."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    up = list(range(len(rows)))
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * len(sets[i] | sets[j]):
                pairs.append(both / len(sets[i] | sets[j]))
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    first = {}
    for (i, _), u in zip(rows, up, strict=True):
        first[u] = min(first.get(u, i), i)
    return sorted(first.values()), pairs


def test_pipeline_removes_near_copies_of_four_fifths_and_no_others(spark):
    r = random.Random(5)
    texts = []
    for k in range(40):
        base = words(r.choice((60, 150, 400)), k).split()
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6, 9):
            w = list(base)
            for at in r.sample(range(len(w)), edits):
                w[at] = f"edit{r.randint(0, 10**9)}"
            texts.append(" ".join(w))
    hub = words(200, 99).split()
    texts += [" ".join([*hub[:at], f"own{at}", *hub[at + 1 :]]) for at in range(0, 200, 3)]
    line = words(12, 77)
    texts += [line + "\n" + words(40, 1000 + k) for k in range(60)]
    r.shuffle(texts)
    rows = list(enumerate(texts, 1))
    stays, found = near_groups(rows)
    assert sum(0.8 <= j < 0.95 for j in found) > 50
    docs = awkward(spark, rows)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == stays


def test_near_copies_on_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "A  b"), (None, "a c"), (None, "a c"), (4, "a b c")]
    kept = corpus_pipeline.near_duplicates(spark, awkward(spark, rows), "").collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in kept) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    assert corpus_pipeline.near_duplicates(spark, awkward(spark, []), "").count() == 0


def test_a_group_of_near_copies_is_joined_by_few_pairs(spark, monkeypatch):
    r = random.Random(8)
    base = words(400, 3).split()
    texts = [" ".join(base)]
    for k in range(150):
        w = list(base)
        for at in r.sample(range(len(w)), 7):
            w[at] = f"own{k}x{at}"
        texts.append(" ".join(w))
    asked, possible = [], near_copies._possible

    def counted(pairs, *how):
        asked.append(pairs.count())
        return possible(pairs, *how)

    monkeypatch.setattr(near_copies, "_possible", counted)
    rows = list(enumerate(texts, 1))
    kept = corpus_pipeline.near_duplicates(spark, awkward(spark, rows), "")
    assert sorted(x["doc_id"] for x in kept.collect()) == near_groups(rows)[0]
    assert sum(asked) <= 3 * len(texts)


def test_crowds_of_near_copies_are_compared_by_what_sets_them_apart(spark, monkeypatch):
    r = random.Random(11)
    texts = []
    for k in range(2):
        base = words(150, 50 + k).split()
        for copy in range(130):
            w = list(base)
            for at in r.sample(range(len(w)), r.choice((1, 2, 3, 3, 4, 5))):
                w[at] = f"own{k}x{copy}x{at}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts, 1))
    met, inner = [], near_copies._met

    def counted(mixed, own, how):
        met.append((inner(mixed, own, how).count(), inner(mixed, own.limit(0), how).count()))
        return inner(mixed, own, how)

    monkeypatch.setattr(near_copies, "_met", counted)
    want, docs = near_groups(rows)[0], awkward(spark, rows)
    kept = near_copies.first_of_near_copies(docs, how=near_copies.NearCopies(crowd=8, rounds=1)).collect()
    assert sorted(x["doc_id"] for x in kept) == want
    assert all(after * 10 < before for after, before in met)


def test_rows_around_a_centre_stay_few_as_its_texts_grow(spark, monkeypatch):
    how, r = near_copies.NearCopies(), random.Random(21)
    base, other = words(146, 21).split(), words(600, 22).split()
    met, meeting = [], near_copies._meeting

    def counted(*given):
        out = meeting(*given)
        met.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "_meeting", counted)
    rows = {}
    for size in (150, 600):
        sets = [frozenset(near_copies.shingles(" ".join(base)).tolist())]
        while len(sets) < size:
            w = list(base)
            for at in sorted(r.sample(range(len(w)), r.choice((1, 2, 3, 3, 4, 5, 6))), reverse=True):
                w[at : at + 1] = r.choice(([r.choice(other)], [r.choice(other)], [w[at] + str(r.random())], [], [w[at], w[at]]))
            sets.append(frozenset(near_copies.shingles(" ".join(w)).tolist()))
        hub, near = sets[0], lambda s, t: 9 * len(s & t) >= 4 * (len(s) + len(t))
        alone = lambda i: 0 if near(sets[i], hub) else i  # noqa: B023, E731
        own = spark.createDataFrame([(i, 0, len(s), len(hub), len(s ^ hub), near(s, hub), list(s - hub), list(hub - s)) for i, s in enumerate(sets)], "mark long, centre long, n long, m long, k long, near boolean, adds array<long>, lacks array<long>")
        mixed = spark.createDataFrame([(i, alone(i), len(s)) for i, s in enumerate(sets)], "mark long, g long, n long")
        met.clear()
        links = near_copies._beside(own, mixed, how).collect()
        assert all(near(sets[a], sets[b]) for a, b in links)

        def groups(pairs):
            up = [alone(i) for i in range(size)]  # noqa: B023
            for a, b in pairs:
                if up[a] != up[b]:
                    up = [min(up[a], up[b]) if u in (up[a], up[b]) else u for u in up]
            return up

        assert groups(links) == groups((a, b) for b in range(size) for a in range(b) if near(sets[a], sets[b]))
        # Before, texts of which not both are near the centre met at every element, if as many as either shares with any text could make them near copies.
        held = Counter(d for s in sets for d in s ^ hub)
        some = [frozenset(d for d in s ^ hub if held[d] > 1) for s in sets]
        able = lambda a, b: 9 * (len(sets[a] ^ hub) + len(sets[b] ^ hub) - 2 * min(len(some[a]), len(some[b]))) <= len(sets[a]) + len(sets[b])  # noqa: B023, E731
        before = sum(len(some[a] & some[b]) for b in range(size) for a in range(b) if (alone(a) or alone(b)) and able(a, b))
        rows[size] = (sum(met), before)
    assert rows[600][0] * 20 < rows[600][1], rows
    assert all(now < 4 * size for size, (now, _) in rows.items()), rows
