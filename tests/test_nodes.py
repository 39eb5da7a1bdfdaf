"""Nodes of eight producers from lines as they write them: what the shared queries do not show."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from logloom.operators.search import search_documents
from logloom.sources.producers import COLUMNS, DECODERS, every_node, nodes_of, request_usage, with_turns


def decoded(spark, producer, *records):
    lines = spark.createDataFrame([("f", k, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(records)], "file string, at long, value string")
    return [{k: v for k, v in r.asDict().items() if v is not None and k not in ("file", "at", "n")} for r in nodes_of(lines, producer).orderBy("at", "n").collect()]


@pytest.mark.parametrize("producer", DECODERS)
def test_odd_lines_give_nothing(spark, producer):
    odd = ["", "no json", "[]", "null", "3", "{}", '{"type": "user"}', '{"type": 7, "message": []}', '{"type": "message", "message": {"role": "other"}}', '{"t": "opencode.part"}', '{"params": {"update": 1}}', '{"t": "devin.msg", "msg": {"role": null}}']
    lines = spark.createDataFrame([("f", k, v) for k, v in enumerate([*odd, None])], "file string, at long, value string")
    got = nodes_of(lines, producer)
    assert tuple(got.columns) == COLUMNS
    assert all(r["text"] in (None, "") for r in got.collect())


def test_message_log(spark):
    got = decoded(
        spark, "claude", {"type": "user", "timestamp": "2024-01-01T00:00:00.250Z", "isMeta": True, "message": {"content": "note"}}, {"type": "user", "isCompactSummary": True, "message": {"content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}},
        {"type": "user", "message": {"content": "  "}}, {"type": "assistant", "uuid": "u", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "redacted_thinking"}, {"type": "tool_use", "id": "c", "name": "N", "input": {"x": [1, 2]}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c", "content": [{"type": "text", "text": "out"}]}]}},
    )
    assert got == [
        {"kind": "context", "t_ms": 1704067200250, "text": "note"}, {"kind": "compaction", "text": "a\nb"}, {"kind": "request", "request": "u", "provider": "anthropic"}, {"kind": "reasoning", "request": "u", "text": "hm"},
        {"kind": "tool-call", "request": "u", "call_id": "c", "name": "N", "args": '{"x":[1,2]}'}, {"kind": "tool-result", "call_id": "c", "text": "out", "is_error": False},
    ]


def test_rollout(spark):
    item = lambda **p: {"type": "response_item", "payload": p}
    got = decoded(
        spark, "codex", item(type="reasoning", summary=[{"text": "s"}], content=[{"text": "s"}, {"text": "t"}]), item(type="function_call", call_id="c", namespace="n", name="m", arguments="{}"), item(type="function_call_output", call_id="c", output=json.dumps("x")),
        item(type="function_call_output", call_id="d", output="Process exited with code 2\nbad"), item(type="message", role="developer", content=[{"type": "input_text", "text": "rules"}]), {"type": "turn_context", "payload": {"model": "m1"}},
        {"type": "token_usage_record", "payload": {"response_id": "r", "usage": {"input_tokens": 5, "cached_input_tokens": 9, "output_tokens": 2, "total_tokens": 99}}},
    )
    assert got == [
        {"kind": "reasoning", "text": "s\nt"}, {"kind": "tool-call", "call_id": "c", "name": "n.m", "args": "{}"}, {"kind": "tool-result", "call_id": "c", "text": '"x"', "is_error": False}, {"kind": "tool-result", "call_id": "d", "text": "Process exited with code 2\nbad", "is_error": True},
        {"kind": "context", "text": "rules"}, {"kind": "request", "model": "m1", "scope": "route"}, {"kind": "request", "request": "r", "scope": "record", "input": 0, "output": 2, "cache_read": 9, "total": 99},
    ]


def test_parts_updates_and_chains(spark):
    got = decoded(
        spark, "opencode", {"t": "opencode.message", "time": 5, "msg": {"role": "user"}, "parts": [{"type": "text", "text": "x", "synthetic": True}]}, {"t": "opencode.message", "msg": {"role": "user"}, "parts": [{"type": "compaction"}]},
        {"t": "opencode.part", "messageID": "m", "part": {"type": "tool", "callID": "c", "tool": "bash", "state": {"status": "running", "input": {}}}}, {"t": "opencode.finish", "id": "m", "msg": {"tokens": {"output": 3, "reasoning": 4}}},
    )
    assert got == [{"kind": "context", "t_ms": 5, "text": ""}, {"kind": "compaction", "text": ""}, {"kind": "tool-call", "request": "m", "call_id": "c", "name": "bash", "args": "{}"}, {"kind": "request", "request": "m", "input": 0, "output": 7, "reasoning": 4, "total": 7}]
    got = decoded(spark, "grok", *[{"params": {"update": u}} for u in ({"sessionUpdate": "tool_call_update", "toolCallId": "c", "status": "in_progress"}, {"sessionUpdate": "tool_call_update", "toolCallId": "c", "status": "failed", "content": [{"type": "content", "content": {"type": "text", "text": "no"}}]}, {"sessionUpdate": "turn_completed", "usage": {"inputTokens": 10, "cachedReadTokens": 4, "outputTokens": 1}})])
    assert got == [{"kind": "tool-result", "call_id": "c", "text": "no", "is_error": True}, {"kind": "request", "scope": "turn", "input": 6, "output": 1, "cache_read": 4, "total": 11}]
    got = decoded(spark, "kimi", {"type": "llm.request", "kind": "compaction", "model": "s"}, {"type": "llm.request", "model": "k", "modelAlias": "moon/k"}, {"type": "context.append_message", "message": {"role": "user", "content": [{"type": "text", "text": "q"}], "origin": {"kind": "injection"}}}, {"type": "context.append_loop_event", "event": {"type": "content.part", "turnId": "0", "step": 1, "part": {"type": "think", "think": "t"}}})
    assert got == [{"kind": "request", "model": "k", "provider": "moon", "scope": "route"}, {"kind": "context", "text": "q"}, {"kind": "reasoning", "request": "0.1", "text": "t"}]


def test_steps_follow_requests_and_input(spark):
    rows = [("f", 0, 0, "user", None), ("f", 1, 0, "request", "a"), ("f", 1, 1, "assistant", "a"), ("f", 2, 0, "tool-call", None), ("f", 3, 0, "assistant", "b"), ("f", 4, 0, "tool-result", None), ("f", 5, 0, "reasoning", "b"), ("f", 6, 0, "user", None), ("f", 7, 0, "assistant", None)]
    got = with_turns(spark.createDataFrame(rows, "file string, at long, n long, kind string, request string"))
    assert [(r["at"], r["turn"], r["step"]) for r in got.orderBy("at", "n").collect()] == [(0, 1, 0), (1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 1, 2), (5, 1, 3), (6, 2, 0), (7, 2, 1)]
    assert with_turns(got.select("file", "at", "n", "kind", "request").where(F.lit(False))).count() == 0


def test_requests_count_once_with_what_was_stated_last(spark):
    rows = [("f", 0, "codex", {"type": "turn_context", "payload": {"model": "m1"}}), ("f", 1, "codex", {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 9, "output_tokens": 9}}}}), ("f", 2, "codex", {"type": "token_usage_record", "payload": {"response_id": "r", "usage": {"input_tokens": 5, "output_tokens": 2, "total_tokens": 50}}}),
            ("g", 0, "grok", {"params": {"update": {"sessionUpdate": "user_message_chunk", "content": {"text": "q"}}}}), ("g", 1, "grok", {"params": {"update": {"sessionUpdate": "response_completed", "usage": {"input_tokens": 3, "output_tokens": 1}}}}), ("g", 2, "grok", {"params": {"update": {"sessionUpdate": "turn_completed", "usage": {"inputTokens": 30}}}}),
            ("g", 3, "grok", {"params": {"update": {"sessionUpdate": "user_message_chunk", "content": {"text": "q"}}}}), ("g", 4, "grok", {"params": {"update": {"sessionUpdate": "turn_completed", "usage": {"inputTokens": 30, "totalTokens": 40}}}}),
            ("h", 0, "claude", {"type": "assistant", "requestId": "a", "message": {"model": "x", "usage": {"input_tokens": 1, "output_tokens": 1}}}), ("h", 1, "claude", {"type": "assistant", "requestId": "a", "message": {"usage": {"input_tokens": 1, "output_tokens": 8}}}), ("h", 2, "claude", {"type": "assistant", "requestId": "b", "message": {}})]
    logs = {p: spark.createDataFrame([(f, k, json.dumps(r)) for f, k, q, r in rows if q == p], "file string, at long, value string") for p in ("codex", "grok", "claude")}
    got = request_usage(every_node(logs)).collect()
    assert sorted((r["file"], r["model"] or "", r["measured"], r["input"], r["output"], r["total"], r["scope"] or "") for r in got if r["measured"]) == [("f", "m1", True, 5, 2, 50, ""), ("g", "", True, 3, 1, 4, ""), ("g", "", True, 30, 0, 40, "turn"), ("h", "x", True, 1, 8, 9, "")]
    assert [(r["file"], r["request"], r["input"]) for r in got if not r["measured"]] == [("h", "b", None)]


def test_search_documents_by_role(spark):
    rows = [("user", "hi", None, None), ("context", "no", None, None), ("assistant", " \x00 ", None, None), ("assistant", "a" + "x" * 300 + "b data:image/png;base64,Q", None, None), ("reasoning", "hm", None, None), ("tool-call", None, "bash", '{"command": "ls", "other": 1}'), ("tool-call", None, None, None), ("tool-result", "out", None, None), ("compaction", "s", None, None)]
    nodes = spark.createDataFrame([("f", k, 0, *r) for k, r in enumerate(rows)], "file string, at long, n long, kind string, text string, name string, args string")
    assert [(r["role"], r["text"]) for r in search_documents(nodes).orderBy("at").collect()] == [("human", "hi"), ("assistant", "Q"), ("other", "hm"), ("tool", "bash\ncommand: ls"), ("tool", "tool")]
