"""Every query of the library against its SQL, and its operators on small frames with awkward rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logloom.operators import context as C
from logloom.operators import cost as P
from logloom.operators import diagnostics as D
from logloom.operators import files as X
from logloom.operators import search as S
from logloom.operators import sessions as L
from logloom.operators import trajectory as T
from logloom.operators import usage as U
from logloom.operators.graph import connected_components
from logloom.plans import catalog
from tests.oracle import differences

MESSAGES = "file int, seq int, cat string, tokens bigint"


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    assert differences(spark, name, catalog.queries()[name], catalog.oracle_sql()[name], sf_dir) == ""


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_missing_usage_is_not_zero(spark):
    rows = [("s", "k", "m", " P ", 0, None, None, None, None, None, False), ("s", "k", "", None, 900_001, 5, 1, 2, 3, 4, True)]
    got = {r["model"]: r for r in U.usage_buckets(spark.createDataFrame(rows, "session string, kind string, model string, provider string, t_ms bigint, input bigint, output bigint, cache_read bigint, cache_write bigint, reasoning bigint, measured boolean")).collect()}
    assert (got["m"]["measured"], got["m"]["total"], got["m"]["time"], got["m"]["provider"]) == (0, 0, None, "p")
    own = got["Unknown model"]
    assert (own["provider"], own["time"], own["input"], own["total"]) == ("Unknown provider", 900_000, 10, 11)


def test_repeated_failures_group_until_success_or_boundary(spark):
    kinds = "eees|eeebee"  # errors, success, other file's errors, boundary
    rows, seq = [], 0
    for file, said in enumerate(kinds.split("|")):
        for c in said:
            seq += 1
            rows.append((file, seq, c == "b", c == "e", "t", '{"x": 1, "a": 2}' if seq % 2 else '{"a":2,"x":1}', f"c{seq % 2}"))
    got = D.repeated_failures(spark.createDataFrame(rows, "file int, seq int, boundary boolean, is_error boolean, tool string, args string, code string"))
    key = '{"a":2,"x":1}'
    assert collected(got) == [(0, 1, "t", key, 1, 3, 4, False, "c0,c1"), (1, 1, "t", key, 5, 3, None, False, "c0,c1")]
    other = spark.createDataFrame([(0, k, False, True, "t", f'{{"a": {k}}}', "c") for k in range(6)], "file int, seq int, boundary boolean, is_error boolean, tool string, args string, code string")
    assert D.repeated_failures(other).count() == 0


def test_calls_without_results_run_and_results_without_calls_are_orphans(spark):
    calls = spark.createDataFrame([(1, 1, 10, "a"), (2, 2, 20, "b")], "call_id int, seq int, t_ms bigint, tool string")
    results = spark.createDataFrame([(1, 3, 15, True), (9, 4, 30, False)], "call_id int, seq int, t_ms bigint, is_error boolean")
    assert {(r["call_id"], r["state"], r["duration_ms"]) for r in T.pair_calls(calls, results).collect()} == {(1, "failed", 5), (2, "running", None), (9, "orphan", None)}


def test_merge_keeps_each_file_in_order_when_clocks_go_back(spark):
    log = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 3, None), (2, 1, 4), (3, 1, None)], "file int, seq int, t_ms bigint")
    assert [(r["file"], r["seq"]) for r in T.replay(log).collect()] == [(3, 1), (2, 1), (1, 1), (1, 2), (1, 3)]


def test_surface_counts_what_is_not_yet_gone(spark):
    m = spark.createDataFrame([(1, 1, "system", 10), (1, 2, "user", 5), (1, 3, "assistant", 7), (1, 4, "system", 20), (1, 5, "assistant", 1)], MESSAGES)
    assert collected(C.surface_at_step(m)) == [(1, 3, 2, 15), (1, 5, 3, 32)]
    assert collected(C.header_asof(m)) == [(1, 3, 1, 10), (1, 5, 4, 20)]


@pytest.mark.parametrize("f", [C.categories, C.timeline, C.composition, C.headline, C.derived_system, C.surface_at_step, C.surface_window, C.header_asof, C.attributed_events, C.trend_markers, C.trend_delta, C.step_brief, C.input_peaks, C.official_parts, C.billed_parts, X.locate_steps])
def test_no_messages_give_no_rows(spark, f):
    assert f(spark.createDataFrame([], MESSAGES)).count() == 0


def test_short_needles_find_nothing(spark):
    docs = spark.createDataFrame([("s", "f", 1, "aaaa"), ("s", "f", 2, None)], "session string, file string, line int, text string")
    assert S.hits(docs, " aa ").count() == 0 and S.candidates(docs, "aa").count() == 0
    assert [r["matches"] for r in S.hits(docs, "AAA").collect()] == [1]


def test_keyset_pages_cover_all_rows_once(spark):
    rows = spark.createDataFrame([(i, 100 - i // 3) for i in range(10)], "session int, updated_at bigint")
    seen, after = [], None
    while True:
        page = L.keyset_page(rows, after, 3).collect()
        seen += [r["session"] for r in page]
        if not page[-1]["has_more"]:
            break
        after = page[-1]["updated_at"], page[-1]["session"]
    assert seen == list(range(10))


def test_prices_prefer_the_narrower_rule(spark):
    rules = P.price_rules(spark, [("p/m", 1.0, 1.0, 1.0, 1.0, 1.0), ("p/*", 2.0, 2.0, 2.0, 2.0, 2.0), ("m", 3.0, 3.0, 3.0, 3.0, 3.0)])
    pairs = spark.createDataFrame([("p", "m"), ("p", "x"), ("", "m"), ("q", "m"), ("q", "x"), (None, "m")], "provider string, model string")
    got = {(r["provider"], r["model"]): r["price"] and r["price"]["rule"] for r in P.matched_rules(pairs, rules).collect()}
    assert got == {("p", "m"): "p/m", ("p", "x"): "p/*", ("", "m"): "m", ("q", "m"): "m", ("q", "x"): None, (None, "m"): "m"}


def test_forest_enters_no_cycle(spark):
    nodes = spark.createDataFrame([("a", None, "A", 1), ("b", "a", "B", 2), ("c", "zz", "C", 3), ("x", "y", "X", 4), ("y", "x", "Y", 5)], "id string, parent string, label string, weight bigint")
    assert collected(X.agent_forest(nodes).select("id", "depth", "root", "path")) == [("a", 0, "a", "a"), ("b", 1, "a", "a/b"), ("c", 0, "c", "c"), ("x", 0, "x", "x"), ("y", 0, "y", "y")]


def test_components_of_a_long_path_and_of_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "src int, dst int")
    got = dict(map(tuple, connected_components(edges).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert connected_components(edges.where("src < 0")).count() == 0


def test_line_counts(spark):
    texts = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",), ("\n\n",), (None,)], "t string")
    assert [r[0] for r in texts.select(X.line_count(F.col("t"))).collect()] == [0, 1, 1, 2, 2, None]
