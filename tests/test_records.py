"""Calls, lineage, prices and decoders on small frames with awkward rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from logloom.operators import calls as C
from logloom.operators import cost as P
from logloom.operators import files as X
from logloom.operators import lineage as L
from logloom.sources.transcripts import read_lines, rollout_requests, tree_requests


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_argument_keys_sort_objects_and_leave_the_rest(spark):
    given = ['{ "b": [2, 1], "a": {"d": 1, "c": null} }', "[2, 1]", "ls -l", '"x"', "", None, "{bad"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in given], "a string").select(C.argument_key(F.col("a"))).collect()]
    assert got == ['{"a":{"c":null,"d":1},"b":[2,1]}', *given[1:]]


def test_calls_are_shown_by_their_describing_arguments(spark):
    rows = [("t", '{"x":1,"path":"p","limit":3}'), ("t", '{"x":1}'), ("t", "{}"), ("t", "plain"), ("t", None), ("t", ""), ("t", json.dumps({"x": "y" * 3000}))]
    got = [r[0] for r in spark.createDataFrame(rows, "tool string, args string").select(C.rendered_call(F.col("tool"), F.col("args"))).collect()]
    assert got == ["t\npath: p", 't\n{"x":1}', "t", "t\nplain", "t", "t", "t"]


def test_sources_and_paths(spark):
    names = ["mcp__a__b", "mcp__a_b__c_d", "mcp__a__b__c", "mcp____x", "read", "mcp__a"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in names], "t string").select(C.mcp_server(F.col("t"))).collect()]
    assert got == ["a", "a_b", "a__b", None, None, None]
    paths = [("/w", "/w"), ("/w/a", "/w//"), ("/x", "/w"), ("a", "/w"), ("./a", "/w"), ("C:\\a", "/w"), ("a", None), ("a", "")]
    got = [tuple(r) for r in spark.createDataFrame(paths, "p string, w string").select(C.shown_path(F.col("p"), F.col("w")), C.absolute_path(F.col("p"), F.col("w"))).collect()]
    assert got == [("./", "/w"), ("./a", "/w/a"), ("/x", "/x"), ("./a", "/w/a"), ("./a", None), ("C:\\a", "C:\\a"), ("./a", None), ("./a", None)]


def test_a_search_gives_its_target_and_its_hits(spark):
    rows = [(1, 1, "grep", '{"pattern":"x","path":"d"}', ["d/a", "d/b"]), (1, 2, "grep", '{"path":"d/a"}', ["d/a"]), (1, 3, "grep", "{}", None), (1, 4, "bash", "{}", None), (1, 5, "edit", "bad", None)]
    got = C.file_operations(spark.createDataFrame(rows, "file int, seq int, tool string, args string, matched array<string>"))
    assert [(r["seq"], r["path"], r["pattern"]) for r in got.orderBy("seq", "path").collect()] == [(1, "d", False), (1, "d/a", False), (1, "d/b", False), (2, "d/a", False)]


def test_forks_lose_their_inherited_prefix_alone(spark):
    parents = spark.createDataFrame([("p", k, c) for k, c in enumerate("abcab")], "file string, seq int, print string")
    said = {"copy": "abcabx", "skip": "acxb", "none": "xab", "twice": "aba"}
    forks = spark.createDataFrame([(f, "p", k, c) for f, s in said.items() for k, c in enumerate(s)], "file string, parent string, seq int, print string")
    got: dict = {}
    for f, k, c in collected(L.own_records(forks, parents)):
        got.setdefault(f, []).append((k, c))
    assert {f: "".join(c for _, c in sorted(own)) for f, own in got.items()} == {"copy": "x", "skip": "xb", "none": "xab"}


def test_chains_of_any_length_and_cycles(spark):
    links = [(k, k - 1 if k else None) for k in range(70)] + [(100, 101), (101, 102), (102, 100), (200, 999), (300, 300)]
    got = {r["id"]: (r["root"], r["depth"]) for r in L.chains(spark.createDataFrame(links, "id int, base int")).collect()}
    assert all(got[k] == (0, k) for k in range(70)) and got[200] == (999, 1) and not {100, 101, 102} & got.keys()
    assert L.chains(spark.createDataFrame([], "id int, base int")).count() == 0


def test_pure_cycles_stay_in_the_forest(spark):
    nodes = spark.createDataFrame([("a", None, "x", 1), ("b", "a", "x", 1), ("c", "d", "x", 1), ("d", "c", "x", 1)], "id string, parent string, label string, weight bigint")
    assert collected(X.agent_forest(nodes).select("id", "depth", "root")) == [("a", 0, "a"), ("b", 1, "a"), ("c", 0, "c"), ("d", 0, "d")]


def test_peak_windows_follow_the_zone_and_its_minutes(spark):
    at = lambda day, h, m: 1_704_067_200_000 + ((day * 24 + h) * 60 + m) * 60_000  # noqa: E731  day 0 is Monday, 2024-01-01
    times = [(at(0, 1, 29), False), (at(0, 1, 30), True), (at(0, 1, 59), True), (at(0, 2, 0), False), (at(4, 17, 45), False), (at(5, 1, 45), False)]
    rows = spark.createDataFrame([(t,) for t, _ in times], "t bigint").withColumns({"zone": F.lit("Asia/Shanghai"), "days": F.lit(True), "w": F.expr("array(named_struct('from', 570, 'before', 600))")})
    assert [r[0] for r in rows.select(P.scheduled_peak(F.col("t"), F.col("zone"), F.col("days"), F.col("w"))).collect()] == [v for _, v in times]


def test_usage_records_hold_before_counts_and_repeated_ids_count_once(spark, tmp_path):
    usage = {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 2}
    count = {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": usage}}}
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, [{"type": "session_meta", "payload": {"id": "a", "model_provider": "p"}}, {"type": "turn_context", "payload": {"model": "m1"}}, count, {"type": "turn_context", "payload": {"model": "m2"}}, count])) + "\nbad\n")
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, [count, {"type": "token_usage_record", "payload": {"usage": usage}}, {"type": "token_usage_record", "payload": {}}])))
    got = rollout_requests(read_lines(spark, str(tmp_path))).select("session", "request", "model", "provider", "input", "output", "cache_read")
    assert collected(got) == [("a", "1", "m1", "p", 6, 2, 4), ("a", "2", "m2", "p", 6, 2, 4), ("b", "1", None, None, 6, 2, 4)]
    message = lambda n: {"type": "message", "id": "i", "message": {"role": "assistant", "usage": {"output": n}}}
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/c.jsonl").write_text("\n".join(map(json.dumps, [message(1), message(5), {"type": "message", "id": "j", "message": {"role": "user"}}, {"type": "message", "id": "k", "message": {"role": "assistant"}}])))
    got = tree_requests(read_lines(spark, str(tmp_path / "tree"))).select("request", "measured", "input", "output")
    assert collected(got) == [("i", True, 0, 5), ("k", False, None, None)]
