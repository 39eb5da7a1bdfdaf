"""The trigram index against scanning all texts, after adding, replacing, deleting and compacting."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import search as S
from logloom.sources.trigram_index import Layout, TrigramIndex, grams_of

DOCS = "session string, file string, line long, text string"
QUERIES = ("abc", " Bca ", "ab", "zzzz", "\U0001f600ab")


def scanned(docs, query):
    n = S.needle_of(query)
    counts = [(s, f, k, t.translate(str.maketrans(S.UPPER, S.LOWER)).count(n)) for s, f, k, t in docs if n and t is not None]
    return {c for c in counts if c[-1]}


@pytest.mark.parametrize("layout", [Layout(buckets=5, blocks=4), Layout(buckets=2, blocks=2, few=5, grams=1, worth=1)])
def test_index_equals_a_scan_through_its_life(spark, tmp_path, layout):
    r = random.Random(1)
    make = lambda file, n: [(f"s{k % 3}", file, k, None if k % 17 == 0 else "".join(r.choices("abcABC.é\U0001f600", k=r.randint(0, 12)))) for k in range(n)]
    index, now = TrigramIndex(spark, str(tmp_path / "index"), layout), []

    def same():
        for q in QUERIES:
            assert {tuple(x) for x in index.hits(q).collect()} == scanned(now, q), q

    assert index.hits("abc").count() == index.candidates("abc").count() == 0
    first = [d for f in ("a", "b", "c") for d in make(f, 60)]
    first += [("s9", "a", 900 + k, "abc same text abc") for k in range(20)]
    index.update(spark.createDataFrame(first, DOCS))
    now = first
    same()
    second = make("b", 30) + make("d", 30)
    index.update(spark.createDataFrame(second, DOCS), without=spark.createDataFrame([("b",), ("c",)], "file string"))
    now = [d for d in first if d[1] == "a"] + second
    same()
    index.compact()
    same()
    index.update(without=spark.createDataFrame([("a",), ("nowhere",)], "file string"))
    now = second
    index.compact()
    same()
    assert index._table("texts").count() == len({t for *_, t in now if t is not None})


def test_candidates_cover_all_trigrams_in_first_indexed_order(spark, tmp_path):
    texts = ["xabcx", "abc bcd", "abcd", "bcd", "ABCD!", "abcd"]
    index = TrigramIndex(spark, str(tmp_path / "i"))
    index.update(spark.createDataFrame([("s", "f", k, t) for k, t in enumerate(texts)], DOCS))
    said = {r["text_id"]: r["text"] for r in index._table("texts").collect()}
    got = index.candidates("abcd").collect()
    assert [said[r["text_id"]] for r in got] == ["abc bcd", "abcd", "ABCD!"] and not any(r["truncated"] for r in got)
    got = index.candidates("abcd", 2).collect()
    assert [said[r["text_id"]] for r in got] == ["abc bcd", "abcd"] and all(r["truncated"] for r in got)


def test_a_search_opens_the_folders_that_it_needs(spark, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "i"))
    index.update(spark.createDataFrame([("s", "f", k, f"text number {k:05d} of many") for k in range(3000)], DOCS))
    assert [tuple(x) for x in index.hits("r 01234 o").collect()] == [("s", "f", 1234, 1)]
    plan = index._holders(["012", "123"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram, [012,123])]" in plan
    plan = index.matching_texts("r 01234 o")._jdf.queryExecution().executedPlan().toString()
    assert "block#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "EqualTo(text_id" in plan.split("PushedFilters")[1]


def test_an_unfinished_generation_does_not_count(spark, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "i"))
    index.update(spark.createDataFrame([("s", "f", 1, "one two")], DOCS))
    index._write(spark.createDataFrame([(5, "s", "f", 9)], "text_id long, session string, file string, line long"), "docs", 1)
    assert index.hits("one").count() == 1 and index.documents().count() == 1
    index.update(spark.createDataFrame([("s", "g", 2, "one three")], DOCS))
    assert sorted(r["line"] for r in index.hits("one").collect()) == [1, 2]


def test_grams(spark):
    df = spark.createDataFrame([("",), ("ab",), ("aBc",), ("aaaa",), ("\U0001f600xÉy",), (None,)], "t string")
    assert [r["g"] and sorted(r["g"]) for r in df.select(grams_of(F.col("t")).alias("g")).collect()] == [[], [], ["abc"], ["aaa"], ["xÉy", "\U0001f600xÉ"], []]


def test_postings_of_many_texts_take_few_rows(spark, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "i"))
    docs = spark.createDataFrame([("s", "f", k, f"text number {k:05d} of many") for k in range(3000)], DOCS)
    index.update(docs, without=docs.where("line < 0").select("file"))
    pairs = sum(r["n"] for r in index._table("grams").collect())
    assert pairs > 3000 * 20 and index._table("postings").count() < pairs / 10
    assert sorted(r["text_id"] for r in index._holders(["xt ", "012"]).collect()) == sorted(r["text_id"] for r in index._table("texts").where("text LIKE '%012%'").collect())
