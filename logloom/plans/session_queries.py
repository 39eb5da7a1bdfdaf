"""Queries over sessions, search, trajectories and diagnostics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from logloom.operators import diagnostics as D
from logloom.operators import search as S
from logloom.operators import sessions as L
from logloom.operators import trajectory as T
from logloom.sources.views import NOW_MS, document_view, log_view, message_view, page_view, span_view, table, turn_view, usage_view, with_views

NEEDLE = "License"
_N = NEEDLE.lower()
_FOLD = f"translate(text, '{S.UPPER}', '{S.LOWER}')"
_HITS = f"hits AS (SELECT session, file, line, text, (length({_FOLD}) - length(replace({_FOLD}, '{_N}', ''))) // {len(_N)} AS matches FROM v_doc WHERE contains({_FOLD}, '{_N}'))"
_PAGE = "page AS (SELECT * FROM hits ORDER BY matches DESC, line LIMIT 50)"
_KEY = "substr(sha1(text), 1, 16) AS text_key"
_LIST = f"""s AS (SELECT session, min(t_ms) AS started_at, max(t_ms) AS updated_at, count(*) AS requests, count(DISTINCT kind) AS children, {NOW_MS} - max(t_ms) < {L.LIVE_MS} AS live FROM v_usage GROUP BY 1)"""
_CURSOR = (NOW_MS - 3_600_000, 0)


def _calls(spark, sf_dir):
    log = log_view(spark, sf_dir).where("NOT boundary").withColumn("call_id", F.floor(F.col("seq") / 2).cast("bigint"))
    return T.pair_calls(log.where("seq % 2 = 0"), log.where("seq % 2 = 1"))


def _untimed(spark, sf_dir):
    return log_view(spark, sf_dir).withColumn("t_ms", F.when(F.col("k") % 11 != 0, F.col("t_ms")))


def _failing(spark, sf_dir):
    """The log with arguments in two spellings, and codes."""
    k = F.col("k").cast("string")
    args = F.when(F.col("seq") % 2 == 0, F.concat(F.lit('{"a":1,"b":'), (F.col("k") % 2).cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{ "b": '), (F.col("k") % 2).cast("string"), F.lit(', "a": 1 }')))
    return log_view(spark, sf_dir).withColumns({"args": args, "code": F.concat(F.lit("e"), (F.col("k") % 4).cast("string"))})


def _trouble(spark, sf_dir):
    """Retries, errors and stops with their turn, which a boundary opens, and their step, which a purchase opens."""
    by_file, by_turn = Window.partitionBy("file").orderBy("seq"), Window.partitionBy("file", "turn").orderBy("seq")
    k, kind = F.col("k"), F.col("event_type")
    code = F.when(kind == "view", F.concat(F.lit("r"), k.cast("string"))).when(k == 1, "turn_aborted").when(k != 2, F.concat(F.lit("e"), k.cast("string")))
    numbered = log_view(spark, sf_dir).withColumn("turn", F.count_if("boundary").over(by_file)).withColumn("step", F.count_if(kind == "purchase").over(by_turn))
    named = F.when(kind == "view", "model-retry").when(kind == "error", "turn-error").when((kind == "click") & (k == 3), "turn-max-tokens")
    return numbered.select("file", "turn", "step", "seq", named.alias("kind"), F.when(k % 4 > 0, "scheduled").otherwise("started").alias("state"), code.alias("code"))


QUERIES = {
    "session_listing": (lambda s, d: L.listing(usage_view(s, d), NOW_MS), with_views("v_usage") + f", {_LIST} SELECT * FROM s"),
    "session_keyset_page": (
        lambda s, d: L.keyset_page(L.listing(usage_view(s, d), NOW_MS), _CURSOR, 20),
        with_views("v_usage") + f", {_LIST}, p AS (SELECT * FROM s WHERE updated_at < {_CURSOR[0]} OR (updated_at = {_CURSOR[0]} AND session > {_CURSOR[1]}) ORDER BY updated_at DESC, session LIMIT 21) SELECT *, (SELECT count(*) FROM p) > 20 AS has_more FROM p ORDER BY updated_at DESC, session LIMIT 20",
    ),
    "session_filtered_counts": (
        lambda s, d: L.facet_counts(document_view(s, d), "1", ["en", "de"]),
        with_views("v_doc") + " SELECT 'kind' AS facet, file AS key, count(*) AS n FROM v_doc WHERE contains(lower(session), '1') GROUP BY 2 UNION ALL SELECT 'project', session, count(*) FROM v_doc WHERE contains(lower(session), '1') AND file IN ('en', 'de') GROUP BY 2",
    ),
    "session_duration": (lambda s, d: L.duration(usage_view(s, d)), with_views("v_usage") + " SELECT session, nullif(max(t_ms) - min(t_ms), 0) AS duration_ms FROM v_usage GROUP BY 1"),
    "search_retention": (lambda s, d: L.retained(usage_view(s, d), NOW_MS, 2), with_views("v_usage") + f" SELECT session, max(t_ms) AS updated_at FROM v_usage GROUP BY 1 HAVING max(t_ms) >= {NOW_MS - 2 * 86_400_000}"),
    "text_dedup": (lambda s, d: S.text_dedup(document_view(s, d)), with_views("v_doc") + f" SELECT {_KEY}, min(line) AS first_line, count(*) AS occurrences, max(length(text)) AS n_chars FROM v_doc GROUP BY 1"),
    "search_extract": (
        lambda s, d: page_view(s, d).select("page_id", "path", S.scrubbed(F.col("html")).alias("text")),
        with_views("v_page") + r" SELECT page_id, path, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[A-Za-z0-9+/]{256,}={0,2}', ' '), '(?i)data:[a-z0-9.+/-]*;base64,', ' ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g'), '^\s+|\s+$', '', 'g'), 16384) AS text FROM v_page",
    ),
    "search_candidates": (
        lambda s, d: S.candidates(document_view(s, d), NEEDLE),
        with_views("v_doc") + ", c AS (SELECT line FROM v_doc WHERE " + " AND ".join(f"contains({_FOLD}, '{t}')" for t in S.trigrams(_N)) + ") SELECT line, (SELECT count(*) FROM c) > 4096 AS truncated FROM c ORDER BY line LIMIT 4096",
    ),
    "search_hits": (lambda s, d: S.ranked_hits(document_view(s, d), NEEDLE), with_views("v_doc") + f", {_HITS}, {_PAGE} SELECT session, file, line, matches FROM page"),
    "search_groups": (
        lambda s, d: S.grouped_hits(document_view(s, d), NEEDLE),
        with_views("v_doc") + f", {_HITS}, {_PAGE}, r AS (SELECT session, line, matches, row_number() OVER (PARTITION BY session ORDER BY matches DESC, line) AS place, max(matches) OVER (PARTITION BY session) AS best FROM page) SELECT r.*, CAST((SELECT sum(matches) FROM hits h WHERE h.session = r.session) AS BIGINT) AS total FROM r WHERE place <= 5",
    ),
    "search_kind_filter": (
        lambda s, d: S.within_kind(document_view(s, d), NEEDLE, ["en"]),
        with_views("v_doc") + f", {_HITS} SELECT DISTINCT {_KEY}, matches FROM hits h WHERE EXISTS (SELECT 1 FROM v_doc d WHERE d.file = 'en' AND d.text = h.text)",
    ),
    "search_snippets": (
        lambda s, d: S.snippets(document_view(s, d), NEEDLE),
        with_views("v_doc") + f", {_HITS}, a AS (SELECT *, instr({_FOLD}, '{_N}') AS hit FROM hits) SELECT line, substr(text, greatest(1, hit - 64), hit - greatest(1, hit - 64) + {len(_N) + 64}) AS snippet, hit - greatest(1, hit - 64) AS match_at FROM a",
    ),
    "search_orphans": (
        lambda s, d: S.orphans(S.text_dedup(document_view(s, d)), document_view(s, d).where("file <> 'de'")),
        with_views("v_doc") + f", t AS (SELECT text, count(*) AS occurrences FROM v_doc GROUP BY 1) SELECT {_KEY}, occurrences FROM t WHERE NOT EXISTS (SELECT 1 FROM v_doc d WHERE d.file <> 'de' AND d.text = t.text)",
    ),
    "ledger_search": (lambda s, d: S.with_all_terms(message_view(s, d), "User a E"), with_views("v_msg") + " SELECT file, seq, cat FROM v_msg WHERE contains(lower(cat || ' ' || text), 'user') AND contains(lower(cat || ' ' || text), 'a') AND contains(lower(cat || ' ' || text), 'e')"),
    "tool_call_pairing": (
        _calls,
        with_views("v_log") + """, l AS (SELECT *, seq // 2 AS call_id FROM v_log WHERE NOT boundary), c AS (SELECT * FROM l WHERE seq % 2 = 0), r AS (SELECT * FROM l WHERE seq % 2 = 1)
SELECT coalesce(c.call_id, r.call_id) AS call_id, c.seq AS call_seq, r.seq AS result_seq, c.tool, CASE WHEN r.seq IS NULL THEN 'running' WHEN c.seq IS NULL THEN 'orphan' WHEN r.is_error THEN 'failed' ELSE 'done' END AS state, r.t_ms - c.t_ms AS duration_ms FROM c FULL JOIN r ON c.call_id = r.call_id""",
    ),
    "turn_assignment": (lambda s, d: T.turn_assignment(turn_view(s, d)), with_views("v_turn") + " SELECT file, seq, cat, turn, step, (SELECT min(n.seq) FROM v_turn n WHERE n.file = t.file AND n.seq > t.seq AND n.cat = 'assistant') AS next_assistant FROM v_turn t"),
    "replay_order": (
        lambda s, d: T.replay(_untimed(s, d)),
        with_views("v_log") + """, u AS (SELECT file, seq, CASE WHEN k % 11 <> 0 THEN t_ms END AS t_ms FROM v_log),
f AS (SELECT *, coalesce(last_value(t_ms IGNORE NULLS) OVER (PARTITION BY file ORDER BY seq ROWS UNBOUNDED PRECEDING), first_value(t_ms IGNORE NULLS) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), -4611686018427387904) AS t FROM u)
SELECT file, seq, t_ms, max(t) OVER (PARTITION BY file ORDER BY seq ROWS UNBOUNDED PRECEDING) AS merge_ms FROM f""",
    ),
    "timeline_sequence": (lambda s, d: T.timeline_sequence(span_view(s, d)), with_views("v_span") + ' SELECT file, seq, lane, row_number() OVER (PARTITION BY file ORDER BY seq) AS place, start - min(start) OVER (PARTITION BY file) AS offset_ms, "end" - start AS duration_ms FROM v_span'),
    "timeline_idle_compressed": (
        lambda s, d: T.timeline_compressed(span_view(s, d)),
        with_views("v_span") + """, g AS (SELECT *, greatest(0, coalesce(start - max("end") OVER (PARTITION BY file ORDER BY start, "end", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gap FROM v_span),
r AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY file ORDER BY start, "end", seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS removed FROM g) SELECT file, seq, start - removed AS start, "end" - removed AS "end", removed FROM r""",
    ),
    "source_line_targets": (lambda s, d: T.line_targets(log_view(s, d)), with_views("v_log") + " SELECT file, seq, last_value(CASE WHEN k % 4 = 0 THEN seq END IGNORE NULLS) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN 4096 PRECEDING AND CURRENT ROW) AS target FROM v_log"),
    "request_numbering": (lambda s, d: T.number_requests(message_view(s, d)), with_views("v_msg") + " SELECT file, seq, row_number() OVER (PARTITION BY file ORDER BY seq) AS number, CAST(sum(tokens) OVER (PARTITION BY file ORDER BY seq) AS BIGINT) AS running_tokens FROM v_msg WHERE cat = 'assistant'"),
    "step_groups": (
        lambda s, d: T.step_groups(turn_view(s, d)),
        with_views("v_turn") + ", k AS (SELECT file, turn, step, cat, count(*) AS n, min(seq) AS a, max(seq) AS b, sum(tokens) AS t FROM v_turn GROUP BY ALL) SELECT file, turn, step, min(a) AS first_seq, max(b) AS last_seq, CAST(sum(t) AS BIGINT) AS tokens, string_agg(cat || ':' || n, ',' ORDER BY cat || ':' || n) AS kinds FROM k GROUP BY 1, 2, 3",
    ),
    "ledger_layout": (
        lambda s, d: T.ledger(turn_view(s, d)),
        with_views("v_turn") + ", r AS (SELECT file, turn, min(seq) AS seq, 'turn' AS kind, 0 AS level FROM v_turn GROUP BY 1, 2 UNION ALL SELECT file, turn, seq, cat, 1 FROM v_turn) SELECT file, turn, seq, kind, row_number() OVER (PARTITION BY file ORDER BY seq, level) AS place FROM r",
    ),
    "chat_turn_rail": (lambda s, d: T.turn_rail(turn_view(s, d)), with_views("v_turn") + " SELECT file, turn, arg_max(cat, seq) AS cat, left(arg_max(text, seq), 40) AS preview, count(*) - 1 AS folded FROM v_turn GROUP BY 1, 2"),
    "turn_usage": (lambda s, d: T.turn_usage(turn_view(s, d)), with_views("v_turn") + " SELECT file, turn, coalesce(arg_max(tokens, seq) FILTER (seq % 5 = 0), CAST(sum(tokens) AS BIGINT)) AS tokens FROM v_turn GROUP BY 1, 2"),
    "diag_repeated_failures": (
        lambda s, d: D.repeated_failures(_failing(s, d)),
        with_views("v_log") + """, w AS (SELECT *, '{"a":1,"b":' || k % 2 || '}' AS key, 'e' || k % 4 AS code FROM v_log), a AS (SELECT *, count(*) FILTER (boundary) OVER (PARTITION BY file ORDER BY seq) AS seg, count(*) FILTER (NOT boundary) OVER (PARTITION BY file ORDER BY seq) AS idx FROM w),
b AS (SELECT *, count(*) FILTER (NOT is_error) OVER (PARTITION BY file, seg, tool, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM a WHERE NOT boundary),
e AS (SELECT *, idx - lag(idx) OVER (PARTITION BY file, seg, tool, key, run ORDER BY seq) AS gap FROM b WHERE is_error),
g AS (SELECT file, seg, tool, key, run, count(*) AS failures, min(seq) AS first_seq, coalesce(bool_or(gap > 1), false) AS interleaved, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM e GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 3),
h AS (SELECT *, (SELECT min(seq) FROM b WHERE b.file = g.file AND b.seg = g.seg AND b.tool = g.tool AND b.key = g.key AND b.run = g.run AND NOT b.is_error) AS recovered_by FROM g)
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY recovered_by IS NOT NULL, failures DESC, first_seq) AS INTEGER) AS place, tool, key, first_seq, failures, recovered_by, interleaved, codes FROM h""",
    ),
    "diag_model_trouble": (
        lambda s, d: D.model_trouble(_trouble(s, d)),
        with_views("v_log") + """, a AS (SELECT *, CAST(count(*) FILTER (boundary) OVER (PARTITION BY file ORDER BY seq) AS BIGINT) AS turn FROM v_log),
n AS (SELECT file, turn, CAST(count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY file, turn ORDER BY seq) AS BIGINT) AS step, seq, k, event_type, CASE event_type WHEN 'view' THEN 'r' || k ELSE CASE WHEN k = 1 THEN 'turn_aborted' WHEN k <> 2 THEN 'e' || k END END AS code FROM a),
c AS (SELECT *, event_type = 'view' AS retry, event_type = 'error' AS err FROM n WHERE (event_type = 'view' AND k % 4 > 0) OR (event_type = 'error' AND coalesce(code, '') <> 'turn_aborted') OR (event_type = 'click' AND k = 3))
SELECT file, turn, step, min(seq) AS seq, count(*) FILTER (retry) AS retries, count(*) FILTER (err) AS errors, count(*) FILTER (NOT retry AND NOT err) AS limits, coalesce(arg_max(code, seq) FILTER (retry), arg_max(coalesce(code, 'error'), seq) FILTER (err)) AS last_code
FROM c GROUP BY 1, 2, 3 HAVING count(*) FILTER (retry) >= 2 OR count(*) FILTER (NOT retry) > 0""",
    ),
    "diag_slowest_tool": (
        lambda s, d: D.slowest_tool(span_view(s, d)),
        with_views("v_span") + """, o AS (SELECT file, lane, seq, "end" - start AS ms FROM (SELECT *, count(*) OVER (PARTITION BY file, start) AS n FROM v_span) WHERE n = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ms DESC, seq) AS r FROM o) SELECT file, lane AS tool, seq, ms, (SELECT median(o.ms) FROM o WHERE o.file = b.file AND o.lane = b.lane) AS median_ms FROM b WHERE r = 1""",
    ),
    "diag_arg_summary": (lambda s, d: table(s, d, "events").select("event_id", D.argument_summary(F.col("props")).alias("summary")), "SELECT event_id, left(trim(regexp_replace(coalesce(json_extract_string(props, '$.path'), json_extract_string(props, '$.query'), json_extract_string(props, '$.k')), '\\s+', ' ', 'g')), 160) AS summary FROM events"),
}
