"""Operator 6, license scans: patience alignment of texts with license templates."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import as_row, fields, map_batches, table

#: Public license notices, by identifier and form.
TEMPLATES = {
    "MIT/line": "Released under the MIT License.",
    "MIT/notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0/notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1/notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0/line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0/line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause/line": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause/line": "Released under the BSD 3-Clause License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0/short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-4.0/long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0/line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0/line": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC0-1.0/line": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "ISC/notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause/notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause/notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
}

#: Letters, digits and bytes beyond ASCII make words, in lower case; all else parts them.
_WORDS = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORDS).split()


@dataclass(frozen=True)
class LicenseScan:
    """coverage: least share of a template's words that an alignment must match. slack: words
    of text that an occurrence may span, in parts of the template's. short: a template of fewer
    words is matched whole and without words in between, as one word tells such lines apart."""

    coverage: float = 0.8
    slack: float = 1.3
    short: int = 20

    def bounds(self, n: int) -> tuple[float, int]:
        """Least coverage, and words of text that an occurrence may span, of a template of n words."""
        return (1.0, n) if n < self.short else (self.coverage, int(n * self.slack) + 1)


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k:
            back[i] = at[k - 1]
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of an alignment, both increasing.

    Equal beginnings and ends are taken first. Words that occur once on either side are anchors;
    of these the longest increasing subsequence is kept, and each gap between two is aligned in
    the same way. A gap without anchors gives no more pairs.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        kept = [anchors[k] for k in increasing([p for _, p in anchors])]
        if not kept:
            continue
        pairs += kept
        for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)], strict=True):
            if x1 - x0 > 1 and y1 - y0 > 1:
                todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(pairs)


def _apart(found: list[tuple[str, int, int, int, float]], sizes: dict[str, int]) -> list[tuple[str, int, int, int, float]]:
    """Of occurrences that overlap, the one whose template explains the words best, by place.

    Matched words count for it; words of the text in between and of the template left out count
    against it.
    """
    taken: list[tuple[str, int, int, int, float]] = []
    for f in sorted(found, key=lambda f: (f[2] - f[1] + sizes[f[0]] - 3 * f[3], f[1], f[0])):
        if all(f[2] <= t[1] or t[2] <= f[1] for t in taken):
            taken.append(f)
    return sorted(taken, key=lambda f: (f[1], f[0]))


class Templates:
    def __init__(self, templates: dict[str, str], how: LicenseScan):
        self.how = how
        self.words = {name: words_of(t) for name, t in templates.items()}
        self.kinds = {name: frozenset(w) for name, w in self.words.items()}
        self.vocabulary = frozenset().union(*self.kinds.values()) if self.kinds else frozenset()
        # An alignment that misses m words of a template still holds all its kinds but m.
        self.least = {name: max(1, len(self.kinds[name]) - int(len(w) * (1 - how.bounds(len(w))[0]) + 1e-9)) for name, w in self.words.items()}

    def find(self, words: list[bytes]) -> list[tuple[str, int, int, int, float]]:
        """(template, first word, end, matched words, coverage) of every occurrence."""
        known = self.vocabulary.intersection(words)
        if not known:
            return []
        found = []
        for name, template in self.words.items():
            if len(known & self.kinds[name]) >= self.least[name]:
                found += self._occurrences(name, template, words)
        return _apart(found, {n: len(w) for n, w in self.words.items()})

    def _occurrences(self, name: str, template: list[bytes], words: list[bytes]) -> list[tuple[str, int, int, int, float]]:
        kinds, (coverage, span) = self.kinds[name], self.how.bounds(len(template))
        hits = [k for k, w in enumerate(words) if w in kinds]
        count: Counter = Counter()
        out, end, done = [], 0, -1
        for i, at in enumerate(hits):
            while end < len(hits) and hits[end] < at + span:
                count[words[hits[end]]] += 1
                end += 1
            if at > done and len(count) >= self.least[name]:
                pairs = patience(words[at : at + span], template)
                if pairs and pairs[0][0]:  # the occurrence may reach beyond a window that began before it
                    at += pairs[0][0]
                    pairs = patience(words[at : at + span], template)
                if len(pairs) >= coverage * len(template) - 1e-9:
                    done = at + pairs[-1][0]
                    out.append((name, at + pairs[0][0], done + 1, len(pairs), len(pairs) / len(template)))
            gone = words[hits[i]]
            count[gone] -= 1
            if not count[gone]:
                del count[gone]
        return out


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, how: LicenseScan = LicenseScan(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns `row`, n_words, license, coverage, matched, spans.

    spans lists every occurrence as template:first:end:matched in words, by place; of those that
    overlap, the one whose template explains the words best. license,
    coverage and matched are those of the occurrence of most matched words (equal ones: the
    earlier); without any, license is null, coverage 0 and matched 0. A window of text starts at
    each word of a template that its words can follow closely enough, so an occurrence is found
    however often it or its words recur. Null texts count as empty. Repeated rows are scanned
    alike; an empty table gives an empty result.
    """
    made = Templates(TEMPLATES if templates is None else templates, how)

    def of(batch: pa.RecordBatch) -> list:
        out: list[list] = [[], [], [], [], []]
        for t in batch.column(1).to_pylist():
            words = words_of(t or "")
            found = made.find(words)
            best = max(found, key=lambda f: (f[3], -f[1]), default=None)
            for o, v in zip(out, (len(words), best and best[0].split("/")[0], best[4] if best else 0.0, best[3] if best else 0, ",".join(f"{n}:{a}:{b}:{m}" for n, a, b, m, _ in found)), strict=True):
                o.append(v)
        return [batch.column(0), *out]

    rows = as_row(docs, keep, F.col(text).cast("string").alias("text"))
    return map_batches(rows, of, T.StructType([rows.schema["row"], *fields("n_words bigint, license string, coverage double, matched bigint, spans string").fields]), text=1)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), keep=("doc_id",)).select("row.doc_id", "n_words", "license", "coverage", "matched", "spans")
