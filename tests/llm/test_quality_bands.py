"""Every document is judged by some band, however few there are of its language and size."""

from __future__ import annotations

import math
import random

from logloom.llm.quality_rules import METRICS, FertilityBands, quality_rules, script_of
from tests.llm.rows import documents, words


def junk(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(chr(r.randint(0x2600, 0x26FF)) for _ in range(3)) for _ in range(n))


def test_op8_judges_rare_sizes_and_rare_languages(spark):
    rows = [(i, words(120 + i % 60, i), "en") for i in range(200)] + [(300 + k, words(110 + k, 300 + k), "fi") for k in range(3)]
    rows += [(400, junk(4000, 1), "en"), (401, junk(120, 2), "fi"), (402, junk(2500, 3), "xx"), (403, "one two", "yy")]
    got = {r["row"]["doc_id"]: r for r in quality_rules(documents(spark, [(i, t, l, "s", len(t)) for i, t, l in rows])).collect()}
    assert len(got) == len(rows) and not any(got[k]["base_failed"] for k in (400, 401, 402))
    assert not any(got[k]["kept"] for k in range(400, 404))
    assert sum(got[i]["kept"] for i in range(200)) >= 190 and all(got[300 + k]["kept"] for k in range(3))


def test_op8_kept_equals_plain_bands(spark):
    bands = FertilityBands(min_texts=30)
    rows = [(i, words(25 + 3 * i, i) if i % 9 else junk(30 + i, i), ("en", "fi", None)[i % 3] if i < 180 else "xx", "s", 0) for i in range(190)]
    got = {r["row"]["doc_id"]: r for r in quality_rules(documents(spark, rows), bands=bands).collect()}
    group = {i: lang or "script:" + script_of(t) for i, t, lang, *_ in rows}
    size = {i: int(math.log2(max(1, got[i]["n_tokens"])) + 1e-12) for i, *_ in rows}
    able = [i for i, *_ in rows if got[i]["n_words"] >= bands.min_words]

    def of_band(i: int) -> list[int]:
        pool = [k for k in able if group[k] == group[i]]
        pool = pool if len(pool) >= bands.min_texts else able
        out: list[int] = []
        for far in range(64):
            out += [k for k in pool if abs(size[k] - size[i]) == far]
            if len(out) >= bands.min_texts:
                break
        return out

    for i in able:
        fine, members = True, of_band(i)
        for m, least in zip(METRICS, bands.least, strict=True):
            steps = sorted(math.floor(got[k][m] * bands.grid) for k in members)
            lower, upper = (steps[math.ceil(p * len(steps)) - 1] / bands.grid for p in (0.25, 0.75))
            reach = max(bands.reach * (upper - lower), least)
            fine &= (m == "byte_share" or got[i][m] >= lower - reach) and (m == "token_entropy" or got[i][m] <= upper + 1 / bands.grid + reach)
        assert got[i]["kept"] == (fine and not got[i]["base_failed"]), i
    assert 0 < sum(not r["kept"] and not r["base_failed"] for r in got.values())
