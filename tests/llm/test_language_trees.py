"""Context trees against plain recursion, with more languages than one table holds."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import cache

import pytest

from logloom.llm.language_id import Ppm, fit_trees, predict
from tests.llm.rows import documents, words


def plain_bits(texts: list[bytes], depth: int):
    """Code lengths by recursion over counts of every context."""
    after: dict[bytes, Counter] = defaultdict(Counter)
    for t in texts:
        padded = bytes(depth) + t
        for i in range(depth, len(padded)):
            for k in range(depth + 1):
                after[padded[i - k : i]][padded[i]] += 1

    @cache
    def p(context: bytes, byte: int) -> float:
        shorter = (lambda b: p(context[1:], b)) if context else (lambda b: 1 / 256)
        seen = after.get(context)
        if not seen:
            return shorter(byte)
        bottom = sum(seen.values()) + len(seen)
        if byte in seen:
            return seen[byte] / bottom
        return len(seen) / bottom * shorter(byte) / sum(shorter(b) for b in range(256) if b not in seen)

    def bits(t: bytes) -> float:
        padded = bytes(depth) + t
        return -sum(math.log2(p(padded[i - depth : i], padded[i])) for i in range(depth, len(padded)))

    return bits


@pytest.mark.parametrize("block_langs", [1, 2, 4])
def test_op5_equals_plain_recursion(spark, block_langs):
    train = {"aa": ["abra kadabra", "bra abra"], "bb": ["zyx yxz zyz", "xyz"], "cc": ["äöü abra öä", "ü"]}
    asked = ["abra", "zyx abra", "äöx", "qqq", "bra€", "a"]
    docs = documents(spark, [(i, t, lang, "s", 0) for i, (lang, t) in enumerate((lang, t) for lang, ts in train.items() for t in ts)])
    got = predict(documents(spark, [(i, t, None, "s", 0) for i, t in enumerate(asked)]), fit_trees(docs, how=Ppm(depth=2, block_langs=block_langs)), keep=("doc_id",)).select("row.doc_id", "lang_pred", "score", "bits_per_byte").collect()
    codes = {lang: plain_bits([t.encode() for t in ts], 2) for lang, ts in train.items()}
    for i, lang, score, per_byte in got:
        raw = asked[i].encode()
        want = {k: f(raw) for k, f in codes.items()}
        best = min(want.values())
        assert per_byte * len(raw) == pytest.approx(best, rel=1e-4) and want[lang] == pytest.approx(best, rel=1e-4)
        assert score == pytest.approx(1 / sum(2 ** (best - b) for b in want.values()), rel=1e-3)


def test_op5_learns_seventy_languages(spark):
    # Each language has words of its own, with a byte pair that no other has; one is far more frequent.
    own = lambda k: chr(0x0400 + k)
    rows = [(100 * k + i, " ".join(w + own(k) for w in words(12, 7 * k + i).split()), f"l{k:02}", "s", 0) for k in range(70) for i in range(40 if k == 3 else 3)]
    asked = documents(spark, [(k, " ".join(w + own(k) for w in words(8, 9000 + k).split()), None, "s", 0) for k in range(70)])
    got = predict(asked, fit_trees(documents(spark, rows), how=Ppm(contexts=500, block_langs=16)), keep=("doc_id",)).select("row.doc_id", "lang_pred").collect()
    assert all(r["lang_pred"] == f"l{r['doc_id']:02}" for r in got) and len(got) == 70
