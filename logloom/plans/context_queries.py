"""Queries over the context window, each with its SQL; joins there check the windows here."""

from __future__ import annotations

from logloom.operators import context as C
from logloom.sources.views import message_view, turn_view, usage_view, with_views

_M, _T, _U = with_views("v_msg"), with_views("v_turn"), with_views("v_usage")


def _before(expr: str, cond: str = "true") -> str:
    return f"coalesce((SELECT CAST(sum({expr}) AS BIGINT) FROM v_msg p WHERE p.file = m.file AND p.seq < m.seq AND {cond}), 0)"


_LINE = "tl AS (SELECT file, seq, " + ", ".join(f"{_before('p.tokens', f'p.cat = {c!r}')} AS \"{c}\"" for c in C.CATEGORIES) + f", {_before('p.tokens')} AS total FROM v_msg m WHERE cat = 'assistant')"
_CATS = "c AS (SELECT file, cat, count(*) AS nodes, CAST(sum(tokens) AS BIGINT) AS tokens FROM v_msg GROUP BY 1, 2)"


def _m(f):
    return lambda spark, sf_dir: f(message_view(spark, sf_dir))


def _t(f):
    return lambda spark, sf_dir: f(turn_view(spark, sf_dir))


def _u(f):
    return lambda spark, sf_dir: f(usage_view(spark, sf_dir))


QUERIES = {
    "token_estimates": (lambda s, d: message_view(s, d).select("file", "seq", "tokens"), _M + " SELECT file, seq, tokens FROM v_msg"),
    "context_categories": (_m(C.categories), _M + f", {_CATS} SELECT * FROM c"),
    "context_timeline": (_m(C.timeline), _M + f", {_LINE} SELECT * FROM tl"),
    "context_composition": (_m(C.composition), _M + " SELECT cat, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / (SELECT sum(tokens) FROM v_msg), 6) AS share FROM v_msg GROUP BY 1"),
    "context_counts": (_t(C.counts), _T + " SELECT file, count(DISTINCT turn) AS turns, count(*) FILTER (cat = 'assistant') AS steps, count(*) FILTER (cat = 'system') AS injects FROM v_turn GROUP BY 1"),
    "context_usage": (
        _u(C.usage),
        _U + """, s AS (SELECT session, count(*) FILTER (measured) AS measured, CAST(sum(cache_read) AS BIGINT) AS cached, CAST(sum(greatest(0, input - cache_read - cache_write)) FILTER (measured) AS BIGINT) AS uncached FROM v_usage GROUP BY 1)
SELECT *, CASE WHEN cached + uncached > 0 THEN floor(cached * 10000 / (cached + uncached)) / 100 END AS hit_percent FROM s""",
    ),
    "context_headline": (
        _m(C.headline),
        _M + ", a AS (SELECT *, max(CASE WHEN cat = 'assistant' THEN seq END) OVER (PARTITION BY file) AS l FROM v_msg), s AS (SELECT file, CAST(coalesce(sum(tokens) FILTER (seq < l), 0) AS BIGINT) AS prompt, CAST(sum(tokens) AS BIGINT) AS current FROM a GROUP BY 1) SELECT *, least(100, current * 100 // 2000) AS percent FROM s",
    ),
    "context_system_derived": (
        _m(C.derived_system),
        _M + f", o AS (SELECT file, seq, CASE WHEN cat = 'assistant' AND seq % 3 = 0 THEN greatest(0, tokens * 4 - {_before('p.tokens')}) END AS own FROM v_msg m) SELECT file, seq, (SELECT arg_max(b.own, b.seq) FROM o b WHERE b.file = o.file AND b.seq <= o.seq AND b.own IS NOT NULL) AS derived FROM o",
    ),
    "surface_at_step": (
        _m(C.surface_at_step),
        _M + """, g AS (SELECT *, CASE WHEN cat = 'system' THEN lead(seq) OVER (PARTITION BY file, cat ORDER BY seq) END AS gone FROM v_msg)
SELECT r.file, r.seq, count(n.seq) AS alive, CAST(coalesce(sum(n.tokens), 0) AS BIGINT) AS tokens FROM g r LEFT JOIN g n ON n.file = r.file AND n.seq < r.seq AND (n.gone IS NULL OR n.gone > r.seq) WHERE r.cat = 'assistant' GROUP BY 1, 2""",
    ),
    "surface_window": (
        _m(C.surface_window),
        _M + ", r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq DESC) <= 3 OR cat = 'system' AS kept FROM v_msg) SELECT file, seq, cat, (SELECT max(x.seq) FROM r x WHERE x.file = r.file AND NOT x.kept) AS floor FROM r WHERE kept",
    ),
    "header_asof": (_m(C.header_asof), _M + ", h AS (SELECT * FROM v_msg WHERE cat = 'system') SELECT m.file, m.seq, h.seq AS header_seq, h.tokens AS header_tokens FROM v_msg m LEFT JOIN h ON h.file = m.file AND h.seq = (SELECT max(x.seq) FROM h x WHERE x.file = m.file AND x.seq < m.seq) WHERE m.cat = 'assistant'"),
    "event_attribution": (
        _m(C.attributed_events),
        _M + ", q AS (SELECT file, seq FROM v_msg WHERE cat = 'assistant') SELECT file, seq, (SELECT min(q.seq) FROM q WHERE q.file = m.file AND q.seq > m.seq) AS next_request, (SELECT max(q.seq) FROM q WHERE q.file = m.file AND q.seq <= m.seq) AS previous_request FROM v_msg m WHERE cat = 'system'",
    ),
    "trend_markers": (
        _m(C.trend_markers),
        _M + ", q AS (SELECT file, seq FROM v_msg WHERE cat = 'assistant'), e AS (SELECT file, seq, (SELECT min(q.seq) FROM q WHERE q.file = m.file AND q.seq >= m.seq) AS request FROM v_msg m WHERE cat = 'system') SELECT file, request, min(seq) AS marker FROM e WHERE request IS NOT NULL GROUP BY 1, 2",
    ),
    "trend_delta": (_m(C.trend_delta), _M + f", {_LINE}, d AS (SELECT file, coalesce(total - lag(total) OVER (PARTITION BY file ORDER BY seq), 0) AS delta FROM tl) SELECT file, CAST(sum(abs(delta)) AS BIGINT) AS churn, CAST(sum(delta) AS BIGINT) AS net FROM d GROUP BY 1"),
    "trend_by_turn": (_t(C.trend_by_turn), _T + " SELECT file, turn, max(seq) AS seq, arg_max(tokens, seq) AS tokens, count(*) AS steps FROM v_turn WHERE cat = 'assistant' GROUP BY 1, 2"),
    "step_brief": (
        _m(C.step_brief),
        _M + """, p AS (SELECT *, (SELECT count(*) FROM v_msg x WHERE x.file = m.file AND x.seq < m.seq AND x.cat = 'assistant') AS step FROM v_msg m)
SELECT file, step, count(*) FILTER (cat <> 'assistant') AS inputs, CAST(coalesce(sum(tokens) FILTER (cat <> 'assistant'), 0) AS BIGINT) AS input_tokens, min(seq) FILTER (cat <> 'assistant') AS opener, max(seq) FILTER (cat = 'assistant') AS response FROM p GROUP BY 1, 2""",
    ),
    "model_switches": (_u(C.model_switches), _U + ", b AS (SELECT session, seq, lag(model) OVER (PARTITION BY session ORDER BY seq) AS before, model FROM v_usage) SELECT * FROM b WHERE before <> model"),
    "retention_last_turns": (_t(C.last_turns), _T + " SELECT file, seq, turn FROM v_turn t WHERE turn > (SELECT coalesce(max(x.turn), -1) FROM v_turn x WHERE x.file = t.file AND (SELECT count(DISTINCT y.turn) FROM v_turn y WHERE y.file = x.file AND y.turn > x.turn) >= 2)"),
    "input_peaks": (_m(C.input_peaks), _M + f", {_LINE} SELECT file, max(total) AS peak, min(seq) FILTER (total = (SELECT max(x.total) FROM tl x WHERE x.file = tl.file)) AS peak_seq FROM tl GROUP BY 1"),
    "parts_official": (
        _m(C.official_parts),
        _M + f""", {_CATS}, t AS (SELECT file, CAST(sum(tokens) AS BIGINT) AS s, CAST(ceil(sum(tokens) / 100) AS BIGINT) * 100 AS official FROM c GROUP BY 1), p AS (SELECT c.file, cat, tokens, official, CAST(floor(tokens * official / s + 0.5) AS BIGINT) AS part FROM c JOIN t ON c.file = t.file)
SELECT file, cat, official, part + CASE WHEN row_number() OVER (PARTITION BY file ORDER BY tokens DESC, cat) = 1 THEN official - CAST(sum(part) OVER (PARTITION BY file) AS BIGINT) ELSE 0 END AS part FROM p""",
    ),
    "parts_billed": (_m(C.billed_parts), _M + f", {_CATS} SELECT file, cat, CAST(floor(tokens * 0.75 + 0.5) AS BIGINT) AS billed FROM c"),
}
