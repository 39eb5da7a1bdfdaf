"""The network sees whole candidates and what surrounds them, and judges every one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from logloom.llm import secret_scan
from logloom.llm.secret_scan import SecretNet, _view, _views, scan

KEY = "Zk3vQ9xLm2Rt8Yw4Hs7Bn1Jd6Fp0Gc5Qa"


def test_op3_finds_keys_behind_paths_and_of_one_kind_of_character(spark):
    secret = [
        "post https://hooks.slack.com/services/T00000000/B00000000/q7XkW2mZ9rTb4YvN8sLd3FhJ now", f"get https://example.com/some/long/path/that/runs/on/and/on/for/many/words/{KEY} now",
        "key = qwXkZmRtBvNsLdFhJpGcQeRuAoYtWz here", "credential: 83920174650192837465019283746 here",
    ]
    plain = ["internationalization efforts and Geschwindigkeitsbegrenzungen", "-" * 60 + " " + "=" * 70, "src/components/widgets/controller/helpers/index/main/view/thing/another/part", "the number 20240102030405067 in a list"]
    rows = spark.createDataFrame(list(enumerate(secret + plain)), "doc_id bigint, text string")
    got = {r["id"]: r["n_network"] for r in scan(rows).select(F.col("row.doc_id").alias("id"), "n_network").collect()}
    assert [got[k] for k in range(8)] == [1] * 4 + [0] * 4


def test_op3_views_cover_a_candidate_and_show_what_follows():
    net = SecretNet()
    for n in (16, 40, 41, 59, 60, 61, 200):
        parts = _views("x" * n, 0, n, net)
        assert parts[0][0] == 0 and parts[-1][1] == n and all(c <= b - (b - a) // 2 for (a, b), (c, _) in zip(parts, parts[1:]))
    seen = [_view(f"{KEY} {after}", 0, len(KEY), net) for after in ("one", "two")]
    assert (np.asarray(seen[0]) != seen[1]).any()


def test_op3_learns_from_every_finding_of_the_corpus(spark, sf_dir, monkeypatch):
    key = "Zk3vQ9xLm2Rt8Yw4Hs7Bn1Jd6Fp0Gc5Qa"
    docs = spark.range(60).select(F.concat(F.lit("token="), F.sha2(F.col("id").cast("string"), 256), F.lit(" then src/some/path/of/words/")).alias("text"))
    docs = docs.union(spark.createDataFrame([(f"password={key * 30} end",), (None,)], "text string"))
    few = SecretNet(examples=40, epochs=1, shard=50, turns=1, rounds=1)
    found, y = secret_scan.corpus_findings(docs, "text", few)
    assert y.sum() == 61 and max(b - a for _, a, b in found) == 30 * len(key)
    counted, inner = [], secret_scan.CharNet.calibrate_counts

    def calibrate(self, counts):
        counted.append(counts)
        return inner(self, counts)

    monkeypatch.setattr(secret_scan.CharNet, "calibrate_counts", calibrate)
    models = [secret_scan.fit_on_corpus(d, "text", few) for d in (docs, docs.repartition(5))]
    held = sum(int(h) % 5 == 0 for h in [r["h"] for r in secret_scan.every_finding(docs, "text", few).where("label = 1").collect()])
    assert counted[0][:, 2].sum() == held + 8 and (counted[0] == counted[1]).all() and models[0].threshold == models[1].threshold
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = secret_scan.fit_on_corpus(docs)
    assert model.recall >= model.net.recall and model.precision > 0.9
