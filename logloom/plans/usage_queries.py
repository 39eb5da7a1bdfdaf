"""Queries over usage, each with the SQL that gives the same rows."""

from __future__ import annotations

from logloom.operators import usage as U
from logloom.sources.views import TODAY, bucket_view, usage_view, with_views

#: Buckets of the finer view, as a common table expression for the queries after it.
_MEASURES = "CASE WHEN measured THEN input + cache_read + cache_write END AS input, CASE WHEN measured THEN output END AS output, CASE WHEN measured THEN cache_read END AS cache_read, CASE WHEN measured THEN cache_write END AS cache_write, CASE WHEN measured THEN reasoning END AS reasoning, CASE WHEN measured THEN input + cache_read + cache_write + output END AS total"
_SUMS = ", ".join(f"CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}" for m in U.MEASURES)


def _buckets_sql(view: str) -> str:
    return f"""b AS (SELECT session, kind, model, lower(trim(provider)) AS provider, CASE WHEN t_ms > 0 THEN t_ms // 900000 * 900000 END AS time, count(*) AS requests, count(*) FILTER (measured) AS measured, {_SUMS}
 FROM (SELECT session, kind, model, provider, t_ms, measured, {_MEASURES} FROM {view}) GROUP BY ALL)"""


_B = with_views("v_usage") + ",\n" + _buckets_sql("v_usage") + ",\nday AS (SELECT strftime(make_timestamp(time * 1000), '%Y-%m-%d') AS day, CAST(sum(total) AS BIGINT) AS total FROM b WHERE time IS NOT NULL GROUP BY 1)\n"


def _on(f, *args, **kw):
    return lambda spark, sf_dir: f(U.usage_buckets(usage_view(spark, sf_dir)), *args, **kw)


def _rank(key: str):
    return _on(U.rank_usage, key), _B + f"SELECT CAST({key} AS VARCHAR) AS key, CAST(sum(total) AS BIGINT) AS total, round(sum(total) / (SELECT sum(total) FROM b), 6) AS share FROM b GROUP BY 1 ORDER BY total DESC, key LIMIT 8"


QUERIES = {
    "usage_buckets": (lambda spark, sf_dir: U.usage_buckets(bucket_view(spark, sf_dir)), with_views("v_bucket") + ",\n" + _buckets_sql("v_bucket") + "\nSELECT * FROM b"),
    "usage_totals": (_on(U.usage_totals), _B + f"SELECT CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(measured) AS BIGINT) AS measured, {_SUMS}, count(DISTINCT session) AS sessions FROM b"),
    "usage_filtered": (
        _on(U.filter_usage, start="2024-01-05", end="2024-01-20", kind="click", provider="p1", query="CLICK m1 p1"),
        _B + "SELECT * FROM b WHERE kind = 'click' AND provider = 'p1' AND contains(lower(concat_ws(' ', kind, model, provider, CAST(session AS VARCHAR))), 'click m1 p1') AND strftime(make_timestamp(time * 1000), '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-20'",
    ),
    "usage_rank_model": _rank("model"),
    "usage_rank_provider": _rank("provider"),
    "usage_rank_session": _rank("session"),
    "usage_daily": (_on(U.daily_summary), _B + "SELECT day, total, day = (SELECT day FROM day ORDER BY total DESC, day LIMIT 1) AS is_peak, (SELECT count(*) FROM day WHERE total > 0) AS active_days FROM day"),
    "usage_hours": (_on(U.by_hour), _B + "SELECT h.hour, CAST(coalesce(sum(total), 0) AS BIGINT) AS total FROM (SELECT unnest(range(24)) AS hour) h LEFT JOIN b ON hour(make_timestamp(time * 1000)) = h.hour GROUP BY 1"),
    "usage_weekdays": (_on(U.by_weekday), _B + "SELECT h.weekday, CAST(coalesce(sum(total), 0) AS BIGINT) AS total FROM (SELECT unnest(range(7)) AS weekday) h LEFT JOIN b ON dayofweek(make_timestamp(time * 1000)) = h.weekday GROUP BY 1"),
    "usage_heatmap": (
        _on(U.heatmap, TODAY),
        _B + f""", spine AS (SELECT strftime(unnest(generate_series(DATE '{TODAY}' - CAST(364 + dayofweek(DATE '{TODAY}') AS INTEGER), DATE '{TODAY}', INTERVAL 1 DAY)), '%Y-%m-%d') AS day),
f AS (SELECT s.day, coalesce(d.total, 0) AS total FROM spine s LEFT JOIN day d ON s.day = d.day)
SELECT day, total, CAST(ceil(sqrt(total / greatest(1, (SELECT max(total) FROM f))) * 4) AS BIGINT) AS level FROM f""",
    ),
    "usage_trend_strided": (
        _on(U.strided_trend, 10),
        _B + ", n AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, greatest(1, CAST(ceil(count(*) OVER () / 10.0) AS BIGINT)) AS stride FROM day) SELECT i // stride AS bar, min(day) AS day, CAST(sum(total) AS BIGINT) AS value FROM n GROUP BY 1",
    ),
    "usage_period_delta": (
        _on(U.period_delta, "2024-01-16", "2024-01-22"),
        _B + ", s AS (SELECT CAST(coalesce(sum(total) FILTER (day BETWEEN '2024-01-16' AND '2024-01-22'), 0) AS BIGINT) AS total, CAST(coalesce(sum(total) FILTER (day BETWEEN '2024-01-09' AND '2024-01-15'), 0) AS BIGINT) AS previous FROM day) SELECT total, previous, CASE WHEN previous > 0 THEN round((total / previous - 1) * 100, 6) END AS change FROM s",
    ),
    "usage_milestone": (_on(U.milestone), _B + f", s AS (SELECT CAST(sum(total) AS BIGINT) AS lifetime FROM b) SELECT lifetime, (SELECT min(m) FROM (SELECT unnest({[*U.MILESTONES]}::BIGINT[]) AS m) WHERE m > lifetime) AS next FROM s"),
    "usage_streak": (
        _on(U.streak, TODAY),
        _B + f""", d AS (SELECT CAST(day AS DATE) AS d FROM day WHERE total > 0), r AS (SELECT d - CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS island, d FROM d), runs AS (SELECT island, count(*) AS run, max(d) AS last FROM r GROUP BY 1)
SELECT coalesce(max(run) FILTER (last = DATE '{TODAY}'), max(run) FILTER (last = DATE '{TODAY}' - 1), 0) AS current, coalesce(max(run), 0) AS longest FROM runs""",
    ),
}
