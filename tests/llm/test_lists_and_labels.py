"""Long lists of urls, licence lines that differ in one word, and what the secret network learns from a corpus."""

from __future__ import annotations

import numpy as np
import pytest

from logloom.llm.license_scan import TEMPLATES, LicenseScan, Templates, op6_license_scan, words_of
from logloom.llm.secret_scan import SecretNet, _all_views, _key, base_spans, candidates, corpus_findings, find_spans, fit_network
from logloom.llm.url_filter import UrlFilter, judge_urls, read_list


def test_op7_a_list_of_a_hundred_thousand_entries_by_array_and_by_join(spark, tmp_path):
    with open(tmp_path / "list.txt", "w") as f:
        f.write("# hosts\n\n" + "".join(f"h{k}.site{k % 97}.org{'/p' if k % 3 == 0 else ''}\n" for k in range(120_000)))
    listed = read_list(spark, str(tmp_path / "list.txt"))
    urls = [f"http://{w}H{k}.site{k % 97}.org/{p}x" for k in range(0, 130_000, 4001) for w in ("", "www.", "x") for p in ("", "p/")] + ["http://net/", None, "none"] + ["http://org/a"] * 40 + ["http://h3.site3.org/p" + "y" * 50_000]
    pages = spark.createDataFrame([(u, k) for k, u in enumerate(urls)], "url string, page_id int")
    a, b = (sorted(judge_urls(pages, listed=listed, how=how).collect(), key=lambda r: r["row"]["page_id"]) for how in (UrlFilter(), UrlFilter(max_rules=1000)))
    assert a == b and len(a) == len(urls)
    hits = {r["row"]["url"]: r["listed"] for r in a}
    assert hits["http://www.H4001.site24.org/x"] == "h4001.site24.org" and hits["http://xH4001.site24.org/x"] is None
    assert hits["http://H12003.site72.org/x"] is None and hits["http://H12003.site72.org/p/x"] == "h12003.site72.org/p"


@pytest.mark.parametrize(("text", "want"), [
    ("Released under the BSD 3-Clause License.", "BSD-3-Clause"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Released under the BSD License.", None),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("Creative Commons Attribution-NonCommercial 4.0 International License", None), (TEMPLATES["AGPL-3.0/notice"], "AGPL-3.0"), (TEMPLATES["LGPL-2.1/notice"], "LGPL-2.1"),
    (TEMPLATES["GPL-2.0/notice"], "GPL-2.0"), (TEMPLATES["BSD-3-Clause/notice"], "BSD-3-Clause"), (TEMPLATES["BSD-2-Clause/notice"], "BSD-2-Clause"), (TEMPLATES["MIT/notice"].replace("charge", "cost"), "MIT"),
])
def test_op6_tells_licences_apart(text, want):
    found = Templates(TEMPLATES, LicenseScan()).find(words_of("Some words before. " + text + " And after."))
    assert [f[0].split("/")[0] for f in found] == ([want] if want else [])


def test_op6_short_lines_equal_a_plain_search(spark, sf_dir):
    docs = {r["doc_id"]: words_of(r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    short = {n: words_of(t) for n, t in TEMPLATES.items() if len(words_of(t)) < LicenseScan().short}
    got = {r["doc_id"]: {s for s in r["spans"].split(",") if s and s.split(":")[0] in short} for r in op6_license_scan(spark, sf_dir).collect()}
    for i, w in docs.items():
        joined = b" " + b" ".join(w) + b" "
        likely = [n for n, t in short.items() if b" " + b" ".join(t) + b" " in joined]
        want = {f"{n}:{k}:{k + len(short[n])}:{len(short[n])}" for n in likely for k in range(len(w)) if w[k : k + len(short[n])] == short[n]}
        assert got[i] == want, i
    assert sum(map(len, got.values())) > 10


def test_op3_learns_from_the_corpus_and_finds_its_held_out_keys(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = SecretNet()
    found, y = corpus_findings(docs.where("doc_id % 5 <> 0"), "text", net)
    again, _ = corpus_findings(docs.where("doc_id % 5 <> 0").repartition(7), "text", net)
    assert found == again and 0 < y.sum() < len(y)
    model = fit_network(net, (found, y))
    assert model.recall >= net.recall and model.precision > 0.9
    keys, plain = [], []
    for (t,) in docs.where("doc_id % 5 = 0 AND text IS NOT NULL").select("text").collect():
        base = base_spans(t)
        keys += [(t, a, b) for a, b in (_key(t, *s) for s in base) if b - a >= 16]
        plain += [(t, a, b) for a, b in candidates(t) if not any(a < e and s < b for s, e, _ in base)]
    p = [model.probability(*_all_views(own, net)[:2]) >= model.threshold if own else np.zeros(0, bool) for own in (keys, plain)]
    assert len(keys) > 5 and p[0].mean() >= 0.9 and (not len(plain) or p[1].mean() <= 0.1)


def test_op3_spans_are_keys_without_names_and_paths():
    model, key = fit_network(), "q8ZkT3vXw9LmP2rYs7NdB4hJ"
    for text in (f"then pwd={key} and more", f"see https://hooks.example.com/services/T00000000/B00000000/{key} now", f"note //{key} here"):
        spans = [text[a:b] for a, b, kind in find_spans(text, model) if kind == "network"]
        assert spans == [key], (text, spans)
