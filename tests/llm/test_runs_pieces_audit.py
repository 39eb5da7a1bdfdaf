"""Operators 11 to 13, against brute force, the sentencepiece library and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from logloom.llm.common import tokenizer_path
from logloom.llm.filter_audit import audit_documents, op13_filter_audit, outcome_matrices
from logloom.llm.periodic_runs import Lags, op11_periodic_runs, periodic_runs, runs_of, zero_stretches
from logloom.llm.piece_codec import PieceCodec, codec, decode_pieces, encode_pieces, op12_piece_codec
from tests.llm.rows import TEXTS, awkward, documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 11: periodic runs ---------------------------------------------------------------------------


def naive_runs(x):
    """Every lag, place by place; the smallest period of a stretch by trying all."""
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            s = x[i : j + q]
            if j > i and len(s) >= max(12, 2 * q) and not any(all(s[k] == s[k + p] for k in range(len(s) - p)) for p in range(1, q)):
                out[i, len(s)] = q
            i = max(j, i + 1)
    return sorted((a, m, q) for (a, m), q in out.items())


def sequences(count):
    r = random.Random(4)
    for k in range(count):
        n, m = r.randint(0, 120), r.choice([1, 2, 3, 5, 50])
        x = [r.randrange(m) for _ in range(n)]
        if k % 4 == 1 and n:
            p, a = r.randint(1, max(1, n // 3)), r.randrange(n)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        elif k % 4 == 2:
            u, v = [r.randrange(m) for _ in range(r.randint(1, 15))], [r.randrange(m) for _ in range(r.randint(1, 5))]
            x = (u * r.randint(1, 4) + v) * r.randint(1, 4) + u * r.randint(1, 3)
        elif k % 4 == 3:
            a, b = [0], [0, 1]
            while len(b) < n:
                a, b = b, b + a
            x = b[:n]
        yield x


def test_op11_runs_equal_trying_every_lag():
    assert sum(len(naive_runs(x)) for x in sequences(400)) > 500
    for x in sequences(400):
        assert runs_of(np.array(x, np.int64)) == naive_runs(x), x


@pytest.mark.parametrize("size, least", [(1, 1), (7, 3), (64, 6), (1000, 17)])
def test_op11_zero_stretches(size, least):
    r = random.Random(size)
    for _ in range(50):
        bits = "".join(r.choices("01", [4, 1], k=size))
        assert zero_stretches(int(bits[::-1], 2), size, least) == [m.span() for m in re.finditer("0+", bits) if len(m.group()) >= least]


def test_op11_lags_that_are_left_out_hold_no_run():
    for x in sequences(200):
        lags = Lags(np.array(x, np.int64)) if len(x) >= 12 else None
        for low in (1, 2, 4, 8, 16, 32) if lags else ():
            counts = dict(enumerate(lags.counts(low), low))
            assert all(counts[q] > 0 for _, _, q in naive_runs(x) if low <= q < 2 * low)


def test_op11_long_texts():
    g = np.random.default_rng(0)
    assert runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert runs_of(g.permutation(200_000)) == []
    once = g.integers(0, 20_000, 200_000)
    once[50_000:] = once[50_000 + np.arange(150_000) % 33_333]
    assert [r for r in runs_of(once) if r[2] > 100] == [(50_000, 150_000, 33_333)]


def test_op11_query_by_brute_force(spark, sf_dir):
    got = {r["doc_id"]: r for r in op11_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and sum(r["n_runs"] > 0 for r in got.values()) > len(docs) / 12
    for d in docs:
        w, h = WORD.findall(d["text"] or ""), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        r = got[d["doc_id"]]
        if len(w) > 600 and h % 10:
            continue  # the plain search is quadratic
        runs = naive_runs(w) if len(w) <= 600 else runs_of(np.unique(w, return_inverse=True)[1])
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()


def test_op11_awkward_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (None, "a b"), (3, "a b " * 9), (3, "a b " * 9)]
    got = periodic_runs(awkward(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = {r["row"]["text"]: r for r in got}
    assert by_text[None]["n_words"] == 0 and by_text[None]["runs"] == [] and by_text[None]["collapsed"] == ""
    assert [tuple(x) for x in by_text["word " * 20_000]["runs"]] == [(0, 20_000, 1)] and by_text["word " * 20_000]["collapsed"] == "word"
    assert [tuple(x) for x in by_text["a b " * 9]["runs"]] == [(0, 18, 2)] and by_text["a b " * 9]["collapsed"] == "a b"
    assert by_text["日本"]["collapsed"] == "日本"
    assert periodic_runs(awkward(spark, [])).count() == 0


# 12: pieces ----------------------------------------------------------------------------------


def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_op12_query_equals_the_library(spark, sf_dir):
    s = library()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d in docs:
        ids = s.encode(d["text"] or "")
        want.append((d["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(s.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, op12_piece_codec(spark, sf_dir).collect())) == sorted(want)


def test_op12_odd_texts_equal_the_library():
    r, s, c = random.Random(1), library(), codec(tokenizer_path("piece_bpe_32k.model"))
    some = ["a", "b", "x", "e", "th", "he", "in", " ", "  ", "   ", "\n", "\t", "▁", "é", "日", "本", "ő", "\U0001f600", "\x00", "<s>", "<0x0A>", "0", "한", "́", "A", "ing", "tion", "----", " " * 21]
    for _ in range(4000):
        t = "".join(r.choices(some, k=r.randint(0, 30)))
        ids, said = c.encode(t)
        assert ids == s.encode(t) and said == ",".join(map(str, ids)) and c.decode(ids).decode() == s.decode(ids), t
    for t in ("x" * 60_000, " " * 60_000, "ab" * 30_000, "word " * 20_000):
        assert c.encode(t)[0] == s.encode(t)


def test_op12_any_ids_decode_as_the_library_does():
    r, s, c = random.Random(2), library(), codec(tokenizer_path("piece_bpe_32k.model"))
    for _ in range(4000):
        ids = [r.choice([0, 1, 2, 259, 3, 200, 230, 240, 28705, 264, r.randrange(32_000)]) for _ in range(r.randint(0, 8))]
        assert c.decode_text(ids) == s.decode(ids), ids


def test_op12_goes_back_where_the_longest_match_fails():
    c = PieceCodec(tokenizer_path("piece_bpe_32k.model"))
    r, stepped = random.Random(3), 0
    for _ in range(3000):
        word = "".join(r.choices("abcdeinorst", k=r.randint(2, 12)))
        greedy, at = [], 0
        while at < len(word):
            greedy.append(next(word[at:e] for e in range(len(word), at, -1) if word[at:e] in c.number))
            at += len(greedy[-1])
        got = [c.text[k] for k in c._word(word)]
        assert got == c.merge(word)
        stepped += got != greedy
    assert stepped > 100


def test_op12_awkward_rows_and_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (2, "a"), (2, "a")]
    made = encode_pieces(awkward(spark, rows))
    got = made.collect()
    assert len(got) == len(rows) and all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert {r["n_tokens"] for r in got if not r["row"]["text"]} == {0}
    back = decode_pieces(made.select(F.col("row.text").alias("said"), "ids")).collect()
    assert all(r["decoded"] == (r["row"]["said"] or "") for r in back)
    odd = spark.createDataFrame([(None,), ([],), ([None, 200, 2, 200],)], "ids array<int>")
    assert [r["decoded"] for r in decode_pieces(odd).collect()] == ["", "", library().decode([200, 2, 200])]
    assert encode_pieces(awkward(spark, [])).count() == 0


# 13: audit -----------------------------------------------------------------------------------


def naive_audit(docs, labels):
    """Each order applied to the documents one after another."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first, rows = {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, lang in docs:
        t, w = t or "", WORD.findall(t or "")
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i), strict=True) if bad}
        rows.setdefault(lang or "", []).append((i, fails))
    out, shapley = {}, {}
    for part, own in rows.items():
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                removed = [x for x in left if f in x[1]]
                gone = [x for x in own if x not in left]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
                out[part, order, k + 1] = [len(left), len(removed), sum(f in own_fails for _, own_fails in gone), sum(x == {f} for _, x in own), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def counted(frame):
    rows = frame.collect()
    made = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(made) == len(rows)
    return made


def test_op13_equals_applying_the_filters_in_turn(spark):
    rows = [(i, t, "en" if i % 3 else None, "s", 1) for i, t in enumerate([*TEXTS, None, words(250, 1), words(250, 1) + " #", "A" + words(300, 2), words(250, 1), "the " * 300, "THE " * 300, words(250, 3).upper(), words(250, 3).upper()])]
    rows += [(2, "a", "en", "s", 1), (2, "a", "en", "s", 1), (None, "a", "en", "s", 1), (None, words(250, 9), "", "s", 1), (50, words(250, 9), "de", "s", 1), (51, words(250, 9), "en", "s", 1), (52, words(250, 9), "en", "s", 1)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (51, None, 1)]
    docs = documents(spark, rows).withColumn("part", F.lit(1)).withColumn("mask", F.lit(2)).withColumn("n", F.lit(3)).withColumn("id", F.lit(4))
    got = counted(audit_documents(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit(7))))
    assert got == naive_audit([r[:3] for r in rows], labels)
    assert len(got) == 3 * 600


def test_op13_query_by_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()][:150]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    some = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    assert counted(audit_documents(some, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))) == naive_audit(docs, labels)
    assert op13_filter_audit(spark, sf_dir).count() == 600 * spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("lang", F.lit(""))).distinct().count()


def test_op13_empty_tables_and_matrices(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit_documents(documents(spark, []), none).count() == 0
    got = counted(audit_documents(documents(spark, [(1, None, None, None, None)]), none))
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
    columns, made = outcome_matrices("ABCDE")
    assert len(columns) == 600 and all(m.shape == (32, 600) for m in made.values())
    assert (made["kept"] + made["removed"] + made["redundant"] <= 1).all()
