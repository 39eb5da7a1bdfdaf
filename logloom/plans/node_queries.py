"""Queries that decode the logs of eight producers into nodes; the logs are rebuilt, as each writes them, from conversations.

All producers tell of the same conversations, so the nodes of each are the same rows: a prompt, an answer with its usage, and of one answer in three a call with its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.plans.decoder_queries import _lines, _when
from logloom.operators.search import search_documents
from logloom.sources.producers import DECODERS, every_node, nodes_of, request_usage, usage_by_producer, with_turns
from logloom.sources.views import with_views


def _s(name: str) -> Column:
    return F.concat(F.lit(name), F.col("seq").cast("string"))


def _obj(**fields: Column | str) -> Column:
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])


def _block(kind: str = "text", **fields: Column) -> Column:
    return F.array(_obj(type=kind, **fields))


def _records(producer: str) -> list[Column]:
    """What a message leaves in a producer's log: a prompt, or an answer and then the result of its call."""
    user, said = F.col("cat") == "user", F.col("cat") == "assistant"
    text, tokens, length, time = F.col("text"), F.col("tokens"), F.col("length"), F.col("time")
    millis = F.unix_millis(F.to_timestamp("time"))
    path = _obj(path=_s("f"))
    seven, calls, error = F.lit(7), F.col("seq") % 3 == 0, F.col("seq") % 2 == 0
    if producer == "claude":
        usage = _obj(input_tokens=tokens, output_tokens=length, cache_read_input_tokens=seven)
        answer = lambda content: _when(said, type=F.lit("assistant"), timestamp=time, requestId=_s("r"), message=_obj(model="m", usage=usage, content=content))
        return [_when(user, type=F.lit("user"), timestamp=time, message=_obj(content=text)), F.when(~calls, answer(_block(text=text))).otherwise(answer(F.array(_obj(type="text", text=text, id=F.lit(None).cast("string"), name=F.lit(None).cast("string"), input=F.lit(None).cast("struct<path: string>")), _obj(type="tool_use", text=F.lit(None).cast("string"), id=_s("c"), name="read", input=path)))),
                _when(said & calls, type=F.lit("user"), timestamp=time, message=_obj(content=_block("tool_result", tool_use_id=_s("c"), is_error=error, content=_s("ok"))))]
    if producer == "codex":
        item = lambda when, payload: _when(when, type=F.lit("response_item"), timestamp=time, payload=payload)
        usage = _obj(input_tokens=tokens + 7, cached_input_tokens=seven, output_tokens=length)
        head = F.when(error, "Exit code: 1\n").otherwise("Exit code: 0\n")
        return [item(user, _obj(type="message", role="user", content=_block("input_text", text=text))), _when(said, type=F.lit("event_msg"), timestamp=time, payload=_obj(type="token_count", info=_obj(last_token_usage=usage))), item(said, _obj(type="message", role="assistant", content=_block("output_text", text=text))),
                item(said & calls, _obj(type="function_call", call_id=_s("c"), name="read", arguments=F.to_json(path))), item(said & calls, _obj(type="function_call_output", call_id=_s("c"), output=F.concat(head, _s("ok"))))]
    if producer == "pi":
        message = lambda when, m: _when(when, type=F.lit("message"), id=_s("r"), timestamp=time, message=m)
        usage = _obj(input=tokens, output=length, cacheRead=seven)
        both = F.array(_obj(type="text", text=text, id=F.lit(None).cast("string"), name=F.lit(None).cast("string"), arguments=F.lit(None).cast("struct<path: string>")), _obj(type="toolCall", text=F.lit(None).cast("string"), id=_s("c"), name="read", arguments=path))
        return [message(user, _obj(role="user", content=text)), message(said & ~calls, _obj(role="assistant", model="m", usage=usage, content=_block(text=text))), message(said & calls, _obj(role="assistant", model="m", usage=usage, content=both)), message(said & calls, _obj(role="toolResult", toolCallId=_s("c"), isError=error, content=_block(text=_s("ok"))))]
    if producer == "kimi":
        event = lambda when, **e: _when(when, type=F.lit("context.append_loop_event"), time=millis, event=_obj(turnId="0", step=F.col("seq").cast("string"), **e))
        return [_when(user, type=F.lit("context.append_message"), time=millis, message=_obj(role="user", content=text)), event(said, type="step.end", usage=_obj(inputOther=tokens, output=length, inputCacheRead=seven)), event(said, type="content.part", part=_obj(type="text", text=text)),
                event(said & calls, type="tool.call", toolCallId=_s("c"), name="read", args=path), event(said & calls, type="tool.result", toolCallId=_s("c"), result=_obj(output=_s("ok"), isError=error))]
    if producer == "opencode":
        part = lambda when, p: _when(when, t=F.lit("opencode.part"), time=millis, messageID=_s("r"), part=p)
        state = _obj(status=F.when(error, "error").otherwise("completed"), input=path, output=F.when(~error, _s("ok")), error=F.when(error, _s("ok")))
        return [_when(user, t=F.lit("opencode.message"), time=millis, id=_s("r"), msg=_obj(role="user"), parts=_block(text=text)), _when(said, t=F.lit("opencode.finish"), time=millis, id=_s("r"), msg=_obj(modelID="m", tokens=_obj(input=tokens, output=length - length % 3, reasoning=length % 3, cache=_obj(read=seven)))),
                part(said, _obj(type="text", text=text)), part(said & calls, _obj(type="tool", callID=_s("c"), tool="read", state=state))]
    if producer == "dsh":
        event = lambda when, kind, data: _when(when, type=F.lit(kind), seq=F.col("seq"), time=millis, data=data)
        usage = _obj(inputTokens=tokens, outputTokens=length, cacheReadTokens=seven)
        return [event(user, "user/message", _obj(content=_block(text=text))), event(said, "assistant/message", _obj(message=_obj(content=_block(text=text), source=_obj(provider="p", model="m")), usage=usage)), event(said & calls, "tool/call", _obj(callId=_s("c"), name="read", arguments=path)),
                event(said & calls, "tool/result", _obj(message=_obj(content=_block("tool-result", toolCallId=_s("c"), isError=error, content=_block(text=_s("ok"))))))]
    if producer == "grok":
        update = lambda when, kind, **u: _when(when, timestamp=millis, method=F.lit("session/update"), params=_obj(update=_obj(sessionUpdate=kind, **u)))
        return [update(user, "user_message_chunk", content=_obj(type="text", text=text)), update(said, "response_completed", usage=_obj(input_tokens=tokens, output_tokens=length, cache_read_input_tokens=seven)), update(said, "agent_message_chunk", content=_obj(type="text", text=text)), update(said & calls, "tool_call", toolCallId=_s("c"), title="read", rawInput=path),
                update(said & calls, "tool_call_update", toolCallId=_s("c"), status=F.when(error, "failed").otherwise("completed"), rawOutput=_s("ok"))]
    message = lambda when, m: _when(when, t=F.lit("devin.msg"), node=F.col("seq"), time=millis, msg=m)
    metrics = _obj(generation_model="m", metrics=_obj(input_tokens=tokens, output_tokens=length, cache_read_tokens=seven))
    return [message(user, _obj(role="user", content=text)), message(said & ~calls, _obj(role="assistant", content=text, metadata=metrics)), message(said & calls, _obj(role="assistant", content=text, metadata=metrics, tool_calls=F.array(_obj(id=_s("c"), function=_obj(name="read", arguments=F.to_json(path)))))),
            message(said & calls, _obj(role="tool", tool_call_id=_s("c"), content=_s("ok"), metadata=_obj(is_error=error)))]


def _log(spark, sf_dir, producer: str) -> DataFrame:
    return _lines(spark, sf_dir, *_records(producer), F.lit("no json"), F.lit("[]"))


_SHOWN = ("t_ms", "text", "call_id", "name", "args", "is_error", "input", "output", "cache_read", "total")


def _nodes(producer: str) -> Callable:
    def query(spark, sf_dir) -> DataFrame:
        plain = F.regexp_replace("text", "^Exit code: .\\n", "") if producer == "codex" else F.col("text")
        return nodes_of(_log(spark, sf_dir, producer), producer).withColumn("text", plain).select("file", F.col("at.seq").alias("seq"), "kind", *_SHOWN)

    return query


_ROWS = with_views("v_msg") + """, m AS (SELECT '/logs/c' || file || '.jsonl' AS file, seq, cat, text, tokens, length(text) AS length, 1704067200250 + (seq % 60) * 60000 AS t_ms FROM v_msg),
n AS (SELECT file, seq, 'user' AS kind, t_ms, text, NULL AS call_id, NULL AS name, NULL AS args, CAST(NULL AS BOOLEAN) AS is_error, CAST(NULL AS BIGINT) AS input, CAST(NULL AS BIGINT) AS output, CAST(NULL AS BIGINT) AS cache_read, CAST(NULL AS BIGINT) AS total FROM m WHERE cat = 'user'
 UNION ALL SELECT file, seq, 'request', t_ms, NULL, NULL, NULL, NULL, NULL, tokens, length, 7, tokens + length + 7 FROM m WHERE cat = 'assistant'
 UNION ALL SELECT file, seq, 'assistant', t_ms, text, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM m WHERE cat = 'assistant'
 UNION ALL SELECT file, seq, 'tool-call', t_ms, NULL, 'c' || seq, 'read', '{"path":"f' || seq || '"}', NULL, NULL, NULL, NULL, NULL FROM m WHERE cat = 'assistant' AND seq % 3 = 0
 UNION ALL SELECT file, seq, 'tool-result', t_ms, 'ok' || seq, 'c' || seq, NULL, NULL, seq % 2 = 0, NULL, NULL, NULL, NULL FROM m WHERE cat = 'assistant' AND seq % 3 = 0)"""


def _steps(spark, sf_dir) -> DataFrame:
    """Nodes, turns and steps of each producer over all logs."""
    logs = {p: _log(spark, sf_dir, p).withColumn("file", F.concat(F.lit(p), F.col("file"))) for p in DECODERS}
    turned = with_turns(every_node(logs))
    return turned.groupBy("producer", "kind", "turn", "step").agg(F.count(F.lit(1)).alias("nodes"))


def _every(spark, sf_dir) -> DataFrame:
    return every_node({p: _log(spark, sf_dir, p).withColumn("file", F.concat(F.lit(p), F.col("file"))) for p in DECODERS})


def _searched(spark, sf_dir) -> DataFrame:
    return search_documents(_every(spark, sf_dir)).select("file", F.col("at.seq").alias("seq"), "role", "text")


def _billed(spark, sf_dir) -> DataFrame:
    used = request_usage(_every(spark, sf_dir)).withColumn("producer", F.split("file", "/")[0])
    return usage_by_producer(used)


_NAMES = "unnest(['claude', 'codex', 'pi', 'kimi', 'opencode', 'dsh', 'grok', 'devin'])"
_TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"

QUERIES = {f"nodes_{p}": (_nodes(p), f"{_ROWS} SELECT * FROM n") for p in DECODERS} | {
    "nodes_turns_and_steps": (
        _steps,
        _ROWS + """, o AS (SELECT *, CASE kind WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 WHEN 'tool-call' THEN 2 ELSE 3 END AS level FROM n WHERE kind <> 'request'), t AS (SELECT *, CAST(count(*) FILTER (kind = 'user') OVER (PARTITION BY file ORDER BY seq, level) AS BIGINT) AS turn FROM o),
s AS (SELECT *, CAST(count(*) FILTER (kind = 'assistant') OVER (PARTITION BY file, turn ORDER BY seq, level) AS BIGINT) AS step FROM t) SELECT unnest(['claude', 'codex', 'pi', 'kimi', 'opencode', 'dsh', 'grok', 'devin']) AS producer, kind, turn, step, count(*) AS nodes FROM s GROUP BY kind, turn, step""",
    ),
    "nodes_search_documents": (
        _searched,
        _ROWS + f""", d AS (SELECT file, seq, CASE kind WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'assistant' ELSE 'tool' END AS role, CASE WHEN kind = 'tool-call' THEN 'read' || chr(10) || 'path: f' || seq ELSE left({_TRIM}, 16384) END AS text FROM n WHERE kind IN ('user', 'assistant', 'tool-call'))
SELECT p.producer || file AS file, seq, role, text FROM d, (SELECT {_NAMES} AS producer) p WHERE text <> ''""",
    ),
    "nodes_usage": (
        _billed,
        _ROWS + f""", u AS (SELECT count(*) AS requests, CAST(sum(input + 7) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(output % 3) AS BIGINT) AS think, CAST(sum(total) AS BIGINT) AS total FROM n WHERE kind = 'request')
SELECT producer, CASE WHEN producer IN ('codex', 'kimi', 'grok') THEN NULL ELSE 'm' END AS model, CASE producer WHEN 'claude' THEN 'anthropic' WHEN 'dsh' THEN 'p' END AS provider, requests, requests AS measured, CAST(0 AS BIGINT) AS turn_totals, input, output, CASE WHEN producer = 'opencode' THEN think ELSE 0 END AS reasoning, total FROM u, (SELECT {_NAMES} AS producer) p""",
    ),
}
