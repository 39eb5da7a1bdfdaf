"""Queries over costs, files, timing and agents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import cost as P
from logloom.operators import files as X
from logloom.operators.graph import connected_components
from logloom.sources.views import bill_view, document_view, message_view, page_view, span_view, table, tree_view, with_views

#: Prices of the queries: of a route, of a provider, and of a model.
RULES = [("FRANCE/Brand#11", 0.1, 1.0, 1.25, 2.0, 5.0), ("GERMANY/*", 0.2, 2.0, 2.5, 4.0, 8.0), ("Brand#12", 0.3, 3.0, 3.75, 6.0, 12.0), ("Brand#23", 0.05, 0.5, 0.625, 1.0, 2.5)]
#: Schedules of the queries: windows in minutes of the day by a zone of eight hours before UTC, and by UTC.
SCHEDULES = [("GERMANY/*", "Asia/Shanghai", True, [(9 * 60, 12 * 60 + 30), (14 * 60, 18 * 60)], 0.5), ("Brand#12", "UTC", False, [(30, 23 * 60)], 0.25)]
_B = with_views("v_bill")
_RULES = "r(rule, hit, miss, \"write\", write_1h, \"out\") AS (VALUES " + ", ".join(str(r) for r in RULES) + ")"
_MATCH = """matched AS (SELECT b.*, coalesce(e.rule, w.rule, m.rule) AS rule FROM v_bill b LEFT JOIN r e ON e.rule = b.provider || '/' || b.model AND b.provider <> '' LEFT JOIN r w ON w.rule = b.provider || '/*' AND b.provider <> '' LEFT JOIN r m ON m.rule = b.model)"""
_PEAK = "(dayofweek(make_timestamp(t_ms * 1000)) BETWEEN 1 AND 5 AND (" + " OR ".join(f"hour(make_timestamp(t_ms * 1000)) >= {a} AND hour(make_timestamp(t_ms * 1000)) < {b}" for a, b in P.PEAK) + "))"
_TIMED = """l AS (SELECT *, make_timestamp((t_ms + CASE WHEN rule = 'GERMANY/*' THEN 28800000 ELSE 0 END) * 1000) AS clock FROM matched), k AS (SELECT *, hour(clock) * 60 + minute(clock) AS m FROM l),
timed AS (SELECT *, CASE rule WHEN 'GERMANY/*' THEN CASE WHEN dayofweek(clock) BETWEEN 1 AND 5 AND (m >= 540 AND m < 750 OR m >= 840 AND m < 1080) THEN 1.0 ELSE 0.5 END WHEN 'Brand#12' THEN CASE WHEN m >= 30 AND m < 1380 THEN 1.0 ELSE 0.25 END ELSE 1.0 END AS part FROM k)"""
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in P.COUNTERS)
_OPS = "ops AS (SELECT page_id AS seq, path, CASE WHEN page_id % 3 = 0 THEN 'write' ELSE 'read' END AS op, {lines} AS lines FROM v_page)"
_LINES = "length({t}) - length(replace({t}, chr(10), '')) + CASE WHEN {t} = '' OR ends_with({t}, chr(10)) THEN 0 ELSE 1 END"
_FORM = "CASE WHEN path = '' THEN 'none' " + " ".join(f"WHEN regexp_matches(lower(path), '{p}') THEN '{n}'" for n, p in X.FORMS) + " ELSE 'other' END"
_FOREST = """f AS (SELECT id, label, weight, CAST(0 AS BIGINT) AS depth, id AS root, id AS path FROM v_tree WHERE parent IS NULL UNION ALL SELECT t.id, t.label, t.weight, f.depth + 1, f.root, f.path || '/' || t.id FROM v_tree t JOIN f ON t.parent = f.id)"""


def _rules(spark):
    return P.price_rules(spark, RULES)


def _ops(spark, sf_dir):
    return page_view(spark, sf_dir).select(F.col("page_id").alias("seq"), "path", F.when(F.col("page_id") % 3 == 0, "write").otherwise("read").alias("op"), X.line_count(F.col("html")).alias("lines"))


def _edges(spark, sf_dir):
    """Documents that begin alike are linked to the first of them, which links them all."""
    docs = document_view(spark, sf_dir).select("line", F.left(F.lower("text"), F.lit(24)).alias("head"))
    first = docs.groupBy("head").agg(F.min("line").alias("dst"))
    return docs.join(first, "head").select(F.col("line").alias("src"), "dst")


def _chains(spark, sf_dir):
    """Chains of twenty customers, some of which hang on another."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"))
    return c.where("src % 20 > 0").select("src", (F.col("src") - 1).alias("dst")).union(c.where("src % 100 = 50").select("src", F.floor(F.col("src") / 2)))


QUERIES = {
    "cost_peak_window": (lambda s, d: bill_view(s, d).groupBy("provider").agg(F.count_if(P.in_peak(F.col("t_ms"))).alias("peak"), F.count(F.lit(1)).alias("requests")), _B + f" SELECT provider, count(*) FILTER ({_PEAK}) AS peak, count(*) AS requests FROM v_bill GROUP BY 1"),
    "cost_rule_match": (
        lambda s, d: P.matched_rules(bill_view(s, d).select("provider", "model").distinct(), _rules(s)).select("provider", "model", F.col("price.rule").alias("rule")),
        _B + f", {_RULES}, {_MATCH} SELECT DISTINCT provider, model, rule FROM matched",
    ),
    "cost_price_resolution": (
        lambda s, d: P.resolved_prices(bill_view(s, d).select("model").distinct(), s.createDataFrame([("Brand#11",), ("BRAND#12",), ("brand#23",), ("BRAND#23",)], "name string")),
        _B + ", g(name) AS (VALUES ('Brand#11'), ('BRAND#12'), ('brand#23'), ('BRAND#23')) SELECT model, coalesce((SELECT name FROM g WHERE name = model), (SELECT CASE WHEN count(*) = 1 THEN min(name) END FROM g WHERE lower(name) = lower(model))) AS entry FROM (SELECT DISTINCT model FROM v_bill)",
    ),
    "cost_buckets": (lambda s, d: P.cost_buckets(bill_view(s, d)), _B + f" SELECT provider, model, {_PEAK} AS peak, count(*) AS requests, {_SUMS} FROM v_bill GROUP BY 1, 2, 3"),
    "cost_session": (
        lambda s, d: P.session_costs(bill_view(s, d), _rules(s), P.peak_schedules(s, SCHEDULES)),
        _B + f""", {_RULES}, {_MATCH}, {_TIMED}, u AS (SELECT session, CAST(sum(CAST(round((cache_read * hit + uncached * miss + (cache_write - least(cache_write_1h, cache_write)) * "write" + least(cache_write_1h, cache_write) * r.write_1h + output * "out") * 1000 * part) AS BIGINT)) AS BIGINT) / 1e9 AS usd, count(*) AS n FROM timed LEFT JOIN r ON r.rule = timed.rule GROUP BY 1)
SELECT session, usd, usd / CAST(0.15 AS DOUBLE) AS cny, usd / n AS usd_each FROM u""",
    ),
    "cost_family": (
        lambda s, d: P.family_costs(bill_view(s, d), table(s, d, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_custkey").alias("root"))),
        _B + f" SELECT o_custkey AS root, provider, {_SUMS} FROM v_bill JOIN orders ON session = o_orderkey GROUP BY 1, 2",
    ),
    "cost_unpriced": (lambda s, d: P.unpriced(bill_view(s, d), _rules(s)), _B + f", {_RULES}, {_MATCH} SELECT DISTINCT provider, model FROM matched WHERE rule IS NULL"),
    "file_forms": (lambda s, d: page_view(s, d).groupBy(X.form_of(F.col("path")).alias("form")).agg(F.count(F.lit(1)).alias("n")), with_views("v_page") + f" SELECT {_FORM} AS form, count(*) AS n FROM v_page GROUP BY 1"),
    "file_activity": (
        lambda s, d: X.file_activity(_ops(s, d)),
        with_views("v_page") + ", " + _OPS.format(lines=_LINES.format(t="html")) + " SELECT path, count(*) FILTER (op = 'read') AS reads, count(*) FILTER (op = 'write') AS writes, CAST(sum(lines) AS BIGINT) AS lines, max(seq) AS last_seq FROM ops GROUP BY 1",
    ),
    "file_op_locate": (
        lambda s, d: X.locate_steps(message_view(s, d)),
        with_views("v_msg") + """, l AS (SELECT file, seq, (SELECT min(a.seq) FROM v_msg a WHERE a.file = m.file AND a.seq > m.seq AND a.cat = 'assistant') AS request, (SELECT min(a.seq) FROM v_msg a WHERE a.file = m.file AND a.seq > m.seq AND a.cat = 'system') AS gone FROM v_msg m WHERE cat = 'user')
SELECT file, seq, CASE WHEN gone IS NULL OR request < gone THEN request END AS request FROM l""",
    ),
    "line_counts": (lambda s, d: document_view(s, d).select("line", X.line_count(F.col("text")).alias("lines")), with_views("v_doc") + f" SELECT line, {_LINES.format(t='text')} AS lines FROM v_doc"),
    "format_humanize": (
        lambda s, d: document_view(s, d).select("line", X.humanized(F.length("text") * 97).alias("shown")),
        with_views("v_doc") + ", n AS (SELECT line, length(text) * 97 AS n FROM v_doc) SELECT line, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 1000000 THEN printf('%.1fK', floor(n * 10 / 1000) / 10) ELSE printf('%.1fM', floor(n * 10 / 1000000) / 10) END AS shown FROM n",
    ),
    "timing_totals": (
        lambda s, d: X.timing_totals(span_view(s, d)),
        with_views("v_span") + ', t AS (SELECT file, max("end") - min(start) AS wall_ms, CAST(sum("end" - start) AS BIGINT) AS busy_ms, arg_min("end" - start, (start, seq)) AS first_ms, sum(k) AS k FROM v_span GROUP BY 1) SELECT file, wall_ms, busy_ms, first_ms, CASE WHEN busy_ms > 0 THEN round(k * 1000 / busy_ms, 1) END AS per_second FROM t',
    ),
    "timing_shares": (
        lambda s, d: X.timing_shares(span_view(s, d)),
        with_views("v_span") + ', t AS (SELECT file, max("end") - min(start) AS wall, sum("end" - start) AS busy FROM v_span GROUP BY 1) SELECT file, CASE WHEN wall > 0 THEN round(least(busy, wall) / wall, 6) END AS busy, CASE WHEN wall > 0 THEN round(1 - least(busy, wall) / wall, 6) END AS idle FROM t',
    ),
    "tool_timing_top": (
        lambda s, d: X.top_tools(span_view(s, d)),
        with_views("v_span") + """, p AS (SELECT file, lane || '-' || k % 7 AS tool, count(*) AS calls, CAST(sum("end" - start) AS BIGINT) AS ms FROM v_span GROUP BY 1, 2) SELECT file, tool, calls, ms FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ms DESC, tool) AS r FROM p) WHERE r <= 16""",
    ),
    "decode_spans": (
        lambda s, d: X.decode_spans(span_view(s, d)),
        with_views("v_span") + ', u AS (SELECT file, lane, coalesce(lead(start) OVER (PARTITION BY file ORDER BY start, seq), max("end") OVER (PARTITION BY file)) - start AS ms FROM v_span) SELECT file, lane, CAST(sum(ms) AS BIGINT) AS ms FROM u GROUP BY 1, 2',
    ),
    "agent_forest": (lambda s, d: X.agent_forest(tree_view(s, d)), with_views("v_tree") + f", {_FOREST} SELECT * FROM f"),
    "agent_nodes": (lambda s, d: X.subtree_sizes(X.agent_forest(tree_view(s, d))), with_views("v_tree") + f", {_FOREST}, u AS (SELECT unnest(string_split(path, '/')) AS id, weight FROM f) SELECT id, count(*) AS size, CAST(sum(weight) AS BIGINT) AS weight FROM u GROUP BY 1"),
    "connected_components_chains": (
        lambda s, d: connected_components(_chains(s, d)),
        """WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey - 1 AS b FROM customer WHERE c_custkey % 20 > 0 UNION SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey % 100 = 50), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS x, a AS y FROM s UNION SELECT r.x, s.b FROM r JOIN s ON s.a = r.y) SELECT x AS vertex, min(y) AS component FROM r GROUP BY 1""",
    ),
    "connected_components": (
        lambda s, d: connected_components(_edges(s, d)),
        with_views("v_doc") + ", h AS (SELECT line, left(lower(text), 24) AS head FROM v_doc), g AS (SELECT head, min(line) AS component, count(*) AS n FROM h GROUP BY 1) SELECT line AS vertex, component FROM h JOIN g USING (head) WHERE n > 1",
    ),
}
