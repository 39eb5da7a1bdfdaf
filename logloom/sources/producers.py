"""Records of eight producers as nodes of one schema: what was said, called, returned and billed, in order.

A node has kind: `user` (a person's prompt), `context` (other input), `system`, `assistant`, `reasoning`,
`tool-call`, `tool-result`, `compaction`, or `request`, which carries a route and usage. Records are
read as variants, so a field that a record lacks is null and a record of another kind gives no node.
Lines that are no JSON objects give none either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FIELDS = {
    "kind": "string", "t_ms": "bigint", "request": "string", "text": "string", "call_id": "string", "name": "string", "args": "string", "is_error": "boolean", "model": "string", "provider": "string",
    "input": "bigint", "output": "bigint", "cache_read": "bigint", "cache_write": "bigint", "reasoning": "bigint", "total": "bigint", "scope": "string",
}
COLUMNS = ("file", "at", "n", *_FIELDS)


def _r() -> Column:
    """The record of a line."""
    return F.col("r")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _time(v: Column) -> Column:
    """Epoch milliseconds of a field time (a number) or timestamp (a number or a date)."""
    return F.coalesce(_get(v, "time", "bigint"), _get(v, "timestamp", "bigint"), F.unix_millis(F.try_to_timestamp(_get(v, "timestamp"))))


def _node(kind: str | Column, **fields: Column) -> Column:
    made = {"kind": F.lit(kind) if isinstance(kind, str) else kind} | fields
    return F.struct(*[made.get(k, F.lit(None)).cast(t).alias(k) for k, t in _FIELDS.items()])


def _when(condition: Column, *nodes: Column | None) -> Column:
    return F.when(condition, F.array(*nodes))


def _blocks(content: Column, path: str) -> Column:
    """An array of variants; a text stands for one block of it."""
    return F.coalesce(_get(content, path, "array<variant>"), F.when(_get(content, path).isNotNull(), F.array(F.to_variant_object(F.struct(F.lit("text").alias("type"), _get(content, path).alias("text"))))), F.array().cast("array<variant>"))


def _plain(blocks: Column) -> Column:
    """The texts of text blocks, joined by line feeds."""
    texts = F.filter(blocks, lambda b: F.coalesce(_get(b, "type"), F.lit("text")).isin("text", "input_text", "output_text"))
    return F.array_join(F.transform(texts, lambda b: F.coalesce(_get(b, "text"), F.lit(""))), "\n")


def _args(v: Column, path: str) -> Column:
    """Arguments as JSON text, whether they were recorded as an object or as text."""
    return _get(v, path)


def _usage(u: Column, input_: str, output: str, read: str, write: str, reasoning: str | None = None, total: str | None = None, whole_input: bool = False, adds_reasoning: bool = False) -> dict[str, Column]:
    """Counters of a usage object, null where it states none of them.

    input is without caches, which are taken out of it where whole_input says that it holds them; output
    holds reasoning, which is added where adds_reasoning says that it does not. total is as stated, else the sum.
    """
    get = lambda p: F.coalesce(*[_get(u, q, "bigint") for q in p.split("|")]) if p else F.lit(None).cast("bigint")
    i, o, r, w, think, t = (get(p) for p in (input_, output, read, write, reasoning, total))
    zero = lambda c: F.coalesce(c, F.lit(0))
    there = reduce(lambda a, b: a | b, (c.isNotNull() for c in (i, o, r, w)))
    uncached = F.greatest(F.lit(0), zero(i) - zero(r) - zero(w)) if whole_input else zero(i)
    said = zero(o) + zero(think) if adds_reasoning else zero(o)
    summed = zero(i) + said if whole_input else uncached + zero(r) + zero(w) + said
    return {"input": F.when(there, uncached), "output": F.when(there, said), "cache_read": r, "cache_write": w, "reasoning": think, "total": F.when(there, F.coalesce(t, summed))}


def _message_log() -> Column:
    m, kind = _get(_r(), "message", "variant"), _get(_r(), "type")
    blocks = _blocks(m, "content")
    results = F.filter(blocks, lambda b: _get(b, "type") == "tool_result")
    request = F.coalesce(_get(_r(), "requestId"), _get(m, "id"), _get(_r(), "uuid"))
    flag = lambda name: F.coalesce(_get(_r(), name, "boolean"), F.lit(False))
    prompt = F.when(flag("isCompactSummary"), "compaction").when(flag("isMeta"), "context").otherwise("user")
    block = lambda b: F.when(_get(b, "type") == "text", _node("assistant", request=request, text=_get(b, "text"))).when(_get(b, "type") == "thinking", _node("reasoning", request=request, text=F.coalesce(_get(b, "thinking"), _get(b, "text")))).when(_get(b, "type") == "tool_use", _node("tool-call", request=request, call_id=_get(b, "id"), name=_get(b, "name"), args=_args(b, "input")))
    usage = _usage(_get(m, "usage", "variant"), "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens_details.thinking_tokens")
    return (
        F.when((kind == "user") & (F.size(results) > 0), F.transform(results, lambda b: _node("tool-result", call_id=_get(b, "tool_use_id"), text=_plain(_blocks(b, "content")), is_error=F.coalesce(_get(b, "is_error", "boolean"), F.lit(False)))))
        .when((kind == "user") & (F.trim(_plain(blocks)) != ""), F.array(_node(prompt, text=_plain(blocks))))
        .when(kind == "assistant", F.concat(F.array(_node("request", request=request, model=_get(m, "model"), provider=F.lit("anthropic"), **usage)), F.transform(blocks, block)))
    )


def _rollout() -> Column:
    p, kind = _get(_r(), "payload", "variant"), _get(_r(), "type")
    sort, item = _get(p, "type"), kind == "response_item"
    call_id, said = _get(p, "call_id"), _plain(_blocks(p, "content"))
    summary = F.transform(_blocks(p, "summary"), lambda b: _get(b, "text"))
    thought = F.array_join(F.array_distinct(F.concat(summary, F.transform(_blocks(p, "content"), lambda b: _get(b, "text")))), "\n")
    name = F.concat_ws(".", _get(p, "namespace"), F.coalesce(_get(p, "name"), F.lit("tool")))
    output = F.coalesce(_get(p, "output.content"), F.nullif(_plain(_blocks(p, "output")), F.lit("")), F.lit(""))
    # A shell's result says in its head how the command ended.
    failed = (_get(p, "output.success", "boolean") == F.lit(False)) | F.coalesce(F.nullif(F.regexp_extract(output, r"^(?:.*\n)?(?:Exit code|Process exited with code):? *(-?\d+)", 1), F.lit("")) != "0", F.lit(False))
    tokens = lambda u: _usage(u, "input_tokens", "output_tokens", "cached_input_tokens", "", "reasoning_output_tokens", "total_tokens", whole_input=True)
    return (
        F.when(item & (sort == "message") & (_get(p, "role") == "assistant"), F.array(_node("assistant", text=said)))
        .when(item & (sort == "message"), F.array(_node(F.when(_get(p, "role") == "user", "user").otherwise("context"), text=said)))
        .when(item & (sort == "reasoning"), F.array(_node("reasoning", text=thought)))
        .when(item & sort.isin("function_call", "custom_tool_call", "local_shell_call"), F.array(_node("tool-call", call_id=call_id, name=name, args=F.coalesce(_args(p, "arguments"), _args(p, "input"), _args(p, "action")))))
        .when(item & sort.isin("function_call_output", "custom_tool_call_output", "local_shell_call_output"), F.array(_node("tool-result", call_id=call_id, text=output, is_error=F.coalesce(failed, F.lit(False)))))
        .when(kind == "compacted", F.array(_node("compaction", text=_get(p, "message"))))
        .when(kind == "turn_context", F.array(_node("request", model=_get(p, "model"), scope=F.lit("route"))))
        .when((kind == "event_msg") & (sort == "token_count"), F.array(_node("request", **tokens(_get(p, "info.last_token_usage", "variant")))))
        .when(kind == "token_usage_record", F.array(_node("request", request=_get(p, "response_id"), scope=F.lit("record"), **tokens(_get(p, "usage", "variant")))))
    )


def _tree() -> Column:
    m, kind, role = _get(_r(), "message", "variant"), _get(_r(), "type"), _get(_r(), "message.role")
    blocks, request = _blocks(m, "content"), _get(_r(), "id")
    usage = _usage(_get(m, "usage", "variant"), "input", "output", "cacheRead", "cacheWrite", "reasoning", "totalTokens")
    block = lambda b: F.when(_get(b, "type") == "text", _node("assistant", request=request, text=_get(b, "text"))).when(_get(b, "type") == "thinking", _node("reasoning", request=request, text=F.coalesce(_get(b, "thinking"), _get(b, "text")))).when(_get(b, "type") == "toolCall", _node("tool-call", request=request, call_id=_get(b, "id"), name=_get(b, "name"), args=_args(b, "arguments")))
    return (
        F.when((kind == "message") & role.isin("user", "system"), F.array(_node(role, text=_plain(blocks))))
        .when((kind == "message") & (role == "toolResult"), F.array(_node("tool-result", call_id=_get(m, "toolCallId"), text=_plain(blocks), is_error=F.coalesce(_get(m, "isError", "boolean"), F.lit(False)))))
        .when((kind == "message") & (role == "assistant"), F.concat(F.array(_node("request", request=request, model=_get(m, "model"), provider=_get(m, "provider"), **usage)), F.transform(blocks, block)))
        .when(kind == "compaction", F.array(_node("compaction", text=_get(_r(), "summary"))))
    )


def _loop_log() -> Column:
    kind, m, e = _get(_r(), "type"), _get(_r(), "message", "variant"), _get(_r(), "event", "variant")
    event, part = _get(e, "type"), F.coalesce(_get(e, "part", "variant"), e)
    request = F.concat_ws(".", _get(e, "turnId"), _get(e, "step"))
    counters = ("inputOther", "output", "inputCacheRead", "inputCacheCreation")
    loop = kind == "context.append_loop_event"
    human = F.coalesce(_get(m, "origin.kind"), F.lit("user")) == "user"
    return (
        F.when((kind == "context.append_message") & (_get(m, "role") == "user"), F.array(_node(F.when(human, "user").otherwise("context"), text=_plain(_blocks(m, "content")))))
        .when(loop & (event == "content.part"), F.array(_node(F.when(_get(part, "type") == "think", "reasoning").otherwise("assistant"), request=request, text=F.coalesce(F.when(_get(part, "type") == "think", _get(part, "think")), _get(part, "text")))))
        .when(loop & (event == "tool.call"), F.array(_node("tool-call", request=request, call_id=_get(e, "toolCallId"), name=F.coalesce(_get(e, "name"), F.lit("tool")), args=_args(e, "args"))))
        .when(loop & (event == "tool.result"), F.array(_node("tool-result", request=request, call_id=_get(e, "toolCallId"), text=F.coalesce(_get(e, "result.output"), _get(e, "result")), is_error=F.coalesce(_get(e, "result.isError", "boolean"), F.lit(False)))))
        .when(loop & (event == "step.end"), F.array(_node("request", request=request, **_usage(_get(e, "usage", "variant"), *counters))))
        .when((kind == "llm.request") & (F.coalesce(_get(_r(), "kind"), F.lit("")) != "compaction"), F.array(_node("request", model=_get(_r(), "model"), provider=F.nullif(F.regexp_extract(_get(_r(), "modelAlias"), "^([^/]+)/", 1), F.lit("")), scope=F.lit("route"))))
        .when(kind == "context.apply_compaction", F.array(_node("compaction", text=_get(_r(), "summary"))))
    )


def _parts_log() -> Column:
    kind, m, part = _get(_r(), "t"), _get(_r(), "msg", "variant"), _get(_r(), "part", "variant")
    parts = F.coalesce(_get(_r(), "parts", "array<variant>"), F.array().cast("array<variant>"))
    authored = F.filter(parts, lambda p: (_get(p, "type") == "text") & ~F.coalesce(_get(p, "synthetic", "boolean"), F.lit(False)))
    compacts = F.exists(parts, lambda p: F.coalesce(_get(p, "type") == "compaction", F.lit(False)))
    request, status, sort = _get(_r(), "messageID"), _get(part, "state.status"), _get(part, "type")
    call = _node("tool-call", request=request, call_id=_get(part, "callID"), name=_get(part, "tool"), args=_args(part, "state.input"))
    result = _node("tool-result", request=request, call_id=_get(part, "callID"), text=F.coalesce(F.when(status == "error", _get(part, "state.error")), _get(part, "state.output"), F.lit("")), is_error=status == "error")
    usage = _usage(_get(m, "tokens", "variant"), "input", "output", "cache.read", "cache.write", "reasoning", "total", adds_reasoning=True)
    return (
        F.when((kind == "opencode.message") & (_get(m, "role") == "user"), F.array(_node(F.when(compacts, "compaction").when(F.size(authored) > 0, "user").otherwise("context"), text=_plain(authored))))
        .when((kind == "opencode.part") & sort.isin("text", "reasoning"), F.array(_node(F.when(sort == "text", "assistant").otherwise("reasoning"), request=request, text=_get(part, "text"))))
        .when((kind == "opencode.part") & (sort == "tool"), F.when(status.isin("completed", "error"), F.array(call, result)).otherwise(F.array(call)))
        .when(kind == "opencode.finish", F.array(_node("request", request=_get(_r(), "id"), model=_get(m, "modelID"), provider=_get(m, "providerID"), **usage)))
    )


def _event_log() -> Column:
    kind, d = _get(_r(), "type"), _get(_r(), "data", "variant")
    m = _get(d, "message", "variant")
    blocks, request = _blocks(m, "content"), _get(_r(), "seq")
    block = lambda b: F.when(_get(b, "type").isin("text", "reasoning"), _node(F.when(_get(b, "type") == "text", "assistant").otherwise("reasoning"), request=request, text=_get(b, "text")))
    results = F.filter(blocks, lambda b: _get(b, "type") == "tool-result")
    plugin = F.coalesce(_get(d, "source.kind"), F.lit("user")) != "user"
    usage = _usage(_get(d, "usage", "variant"), "inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens", "reasoningTokens", "totalTokens")
    return (
        F.when(kind == "user/message", F.array(_node(F.when(_get(d, "source.form") == "compaction", "compaction").when(plugin, "context").otherwise("user"), text=_plain(_blocks(d, "content")))))
        .when(kind == "assistant/message", F.concat(F.array(_node("request", request=request, model=_get(m, "source.model"), provider=_get(m, "source.provider"), **usage)), F.transform(blocks, block)))
        .when(kind == "tool/call", F.array(_node("tool-call", call_id=_get(d, "callId"), name=F.coalesce(_get(d, "name"), F.lit("tool")), args=_args(d, "arguments"))))
        .when(kind == "tool/result", F.transform(results, lambda b: _node("tool-result", call_id=_get(b, "toolCallId"), text=_plain(_blocks(b, "content")), is_error=F.coalesce(_get(b, "isError", "boolean"), F.lit(False)))))
        .when(kind == "system/message", F.array(_node("system", text=_plain(_blocks(d, "content")))))
    )


def _update_log() -> Column:
    u = _get(_r(), "params.update", "variant")
    kind, call_id, said, status = _get(u, "sessionUpdate"), _get(u, "toolCallId"), _get(u, "content.text"), _get(u, "status")
    name = F.coalesce(_get(u, "_meta.tool_name"), _get(u, "title"), F.lit("tool"))
    answer = _usage(_get(u, "usage", "variant"), "input_tokens|inputTokens", "output_tokens|outputTokens", "cache_read_input_tokens|cacheReadInputTokens", "cache_creation_input_tokens|cacheCreationInputTokens", "reasoning_tokens|reasoningTokens")
    turn = _usage(_get(u, "usage", "variant"), "inputTokens", "outputTokens", "cachedReadTokens", "cacheCreationTokens", "reasoningTokens", "totalTokens", whole_input=True)
    return (
        F.when(kind == "user_message_chunk", F.array(_node("user", text=said))).when(kind == "agent_message_chunk", F.array(_node("assistant", text=said))).when(kind == "agent_thought_chunk", F.array(_node("reasoning", text=said)))
        .when(kind == "tool_call", F.array(_node("tool-call", call_id=call_id, name=name, args=_args(u, "rawInput"))))
        .when((kind == "tool_call_update") & status.isin("completed", "failed"), F.array(_node("tool-result", call_id=call_id, text=F.coalesce(_get(u, "rawOutput"), _plain(F.transform(_blocks(u, "content"), lambda b: F.coalesce(_get(b, "content", "variant"), b)))), is_error=status == "failed")))
        .when(kind == "response_completed", F.array(_node("request", **answer))).when(kind == "turn_completed", F.array(_node("request", scope=F.lit("turn"), **turn)))
    )


def _chain_log() -> Column:
    kind, m = _get(_r(), "t"), _get(_r(), "msg", "variant")
    role, request = _get(m, "role"), F.coalesce(_get(m, "message_id"), _get(_r(), "node"))
    calls = F.coalesce(_get(m, "tool_calls", "array<variant>"), F.array().cast("array<variant>"))
    usage = _usage(_get(m, "metadata.metrics", "variant"), "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens|cache_creation_tokens")
    said, human = _plain(_blocks(m, "content")), F.coalesce(_get(m, "metadata.is_user_input", "boolean"), F.lit(True))
    first = F.array(_node("request", request=request, model=_get(m, "metadata.generation_model"), **usage), _node("assistant", request=request, text=said))
    return (
        F.when((kind == "devin.msg") & (role == "user"), F.array(_node(F.when(human, "user").otherwise("context"), text=said)))
        .when((kind == "devin.msg") & (role == "assistant"), F.concat(first, F.transform(calls, lambda c: _node("tool-call", request=request, call_id=_get(c, "id"), name=F.coalesce(_get(c, "function.name"), _get(c, "name")), args=F.coalesce(_args(c, "function.arguments"), _args(c, "arguments"))))))
        .when((kind == "devin.msg") & (role == "tool"), F.array(_node("tool-result", call_id=_get(m, "tool_call_id"), text=said, is_error=F.coalesce(_get(m, "metadata.is_error", "boolean"), F.lit(False)))))
        .when((kind == "devin.msg") & (role == "system"), F.array(_node("system", text=said)))
    )


#: The projection of each producer.
DECODERS = {"claude": _message_log, "codex": _rollout, "pi": _tree, "kimi": _loop_log, "opencode": _parts_log, "dsh": _event_log, "grok": _update_log, "devin": _chain_log}


def nodes_of(lines: DataFrame, producer: str) -> DataFrame:
    """Columns file, at, n and the fields of a node: what each line of one producer's logs stands for; n orders a line's nodes."""
    read = lines.select("file", "at", F.try_parse_json("value").alias("r")).where(F.col("r").isNotNull())
    made = read.select("file", "at", _time(_r()).alias("t"), F.posexplode(DECODERS[producer]()).alias("n", "node")).where("node IS NOT NULL")
    return made.select("file", "at", "n", *[F.coalesce("node.t_ms", "t").alias("t_ms") if k == "t_ms" else F.col(f"node.{k}").alias(k) for k in _FIELDS])


def every_node(logs: dict[str, DataFrame]) -> DataFrame:
    """The nodes of logs of several producers, with the producer."""
    return reduce(DataFrame.unionByName, [nodes_of(lines, p).withColumn("producer", F.lit(p)) for p, lines in sorted(logs.items())])


def with_turns(nodes: DataFrame) -> DataFrame:
    """Nodes with turn, which a user's prompt opens, and step, which counts a turn's answers: what one request has said, or what follows other input; request records are left out."""
    order = Window.partitionBy("file").orderBy("at", "n")
    said = F.col("kind").isin("assistant", "reasoning", "tool-call")
    turned = nodes.withColumn("turn", F.count_if(F.col("kind") == "user").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_turn = Window.partitionBy("file", "turn").orderBy("at", "n")
    before = F.lag(said).over(in_turn)
    asked = F.last(F.when(said, F.col("request")), True).over(in_turn.rowsBetween(Window.unboundedPreceding, -1))
    opens = said & (~F.coalesce(before, F.lit(False)) | F.coalesce(asked != F.col("request"), F.lit(False)))
    # A step's request record may lie between its blocks.
    held = turned.where(F.col("kind") != "request").withColumn("opens", opens)
    return held.withColumn("step", F.count_if("opens").over(in_turn.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def request_usage(nodes: DataFrame) -> DataFrame:
    """Columns file, request, model, provider, t_ms, measured, input, output, cache_read, cache_write, reasoning, total, scope: one row per model request.

    Nodes of one request count once, with the last usage that was stated; without an id each is one. A route that a
    log states by itself holds for the requests after it. Where a file has usage records of its own, its
    running counts do not count; usage of a turn as a whole (scope `turn`) counts only where no
    request of the turn has any. A request without usage is unmeasured and its counters are null.
    """
    order = Window.partitionBy("file").orderBy("at", "n")
    so_far, of_file = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("file")
    route = F.coalesce(F.col("scope") == "route", F.lit(False))
    stated = lambda c: F.last(F.when(route, F.col(c)), True).over(so_far)
    counters = ("input", "output", "cache_read", "cache_write", "reasoning", "total")
    r = nodes.where(F.col("kind").isin("request", "user"))
    r = r.withColumns({"model": F.coalesce("model", stated("model")), "provider": F.coalesce("provider", stated("provider")), "turn": F.count_if(F.col("kind") == "user").over(so_far), "by_record": F.coalesce(F.bool_or(F.col("scope") == "record").over(of_file), F.lit(False))})
    r = r.where((F.col("kind") == "request") & ~route & (~F.col("by_record") | F.coalesce(F.col("scope") == "record", F.lit(False))))
    whole = F.coalesce(F.col("scope") == "turn", F.lit(False))
    exact = F.coalesce(F.bool_or(~whole & F.col("input").isNotNull()).over(Window.partitionBy("file", "turn")), F.lit(False))
    r = r.withColumn("exact", exact).where(~whole | ~F.col("exact")).withColumn("place", F.struct("at", "n"))
    one = r.groupBy("file", F.coalesce("request", F.to_json(F.struct("at", "n"))).alias("request")).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c) for c in ("model", "provider")], F.min("t_ms").alias("t_ms"), F.max_by(F.struct(*counters, "scope"), F.when(F.col("input").isNotNull(), F.col("place"))).alias("u"),
    )
    scope = F.when(F.col("u.scope") == "turn", "turn")
    return one.select("file", "request", "model", "provider", "t_ms", F.col("u").isNotNull().alias("measured"), *[F.col(f"u.{c}").alias(c) for c in counters], scope.alias("scope"))


def usage_by_producer(requests: DataFrame) -> DataFrame:
    """One row per producer, model and provider: requests, measured, turn_totals, and sums whose input holds the caches and whose total is the stated one."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    shown = F.col("input") + F.coalesce("cache_read", F.lit(0)) + F.coalesce("cache_write", F.lit(0))
    return requests.groupBy("producer", "model", "provider").agg(F.count(F.lit(1)).alias("requests"), F.count_if("measured").alias("measured"), F.count_if(F.col("scope") == "turn").alias("turn_totals"), zero(shown).alias("input"), zero("output").alias("output"), zero("reasoning").alias("reasoning"), zero("total").alias("total"))
