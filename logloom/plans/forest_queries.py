"""Queries over forests of records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators import forest as G
from logloom.sources.views import table, tree_view, with_views


def _numbered(spark, sf_dir) -> DataFrame:
    """Each user's events with their number r."""
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), r.cast("bigint").alias("r"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_type")


def _branches(spark, sf_dir) -> DataFrame:
    """A record after each other one, but one in seven goes back to an earlier one, which leaves a branch behind."""
    r, k = F.col("r"), F.col("k")
    parent = F.when(r == 0, None).when(r % 7 == 3, F.greatest(F.lit(0), r - 1 - k % 5)).otherwise(r - 1)
    said = lambda n, name, of: F.when(k % n == 0, F.concat(F.lit(name), (k % of).cast("string"))).alias(name)
    return _numbered(spark, sf_dir).select(
        "file", r.alias("id"), parent.cast("bigint").alias("parent"), (r % 20 == 19).alias("compaction"), F.when(r % 20 == 19, r - 6).alias("first_kept"), (F.col("event_type") == "signup").alias("system"),
        said(3, "provider", 2), said(4, "model", 3), said(9, "thinking", 2),
    )


def _on_branch(f):
    def query(spark, sf_dir):
        records = _branches(spark, sf_dir)
        return f(records, G.last_records(records, "id"))

    return query


def _restores(spark, sf_dir) -> DataFrame:
    """One event in nine goes back some steps, and half of those after it undo that."""
    r, k = F.col("r"), F.col("k")
    return _numbered(spark, sf_dir).select("file", r.alias("seq"), F.when(r % 9 == 5, r - 1 - k % 8).when((r % 9 == 6) & (k % 2 == 0), r - 2).alias("restores"))


def _calls(spark, sf_dir) -> DataFrame:
    """Calls that start others: eleven to a tree."""
    r, k = F.col("r"), F.col("k")
    return _numbered(spark, sf_dir).select("file", r.alias("id"), F.when(r % 11 > 0, F.greatest(r - r % 11, r - 1 - k % 4)).alias("parent"), k.alias("started"))


def _walk(spark, sf_dir) -> DataFrame:
    agents = tree_view(spark, sf_dir).select(F.lit("all").alias("file"), "id", "parent", (F.col("weight") % 2 != 0).alias("stopped"), (-F.col("weight")).alias("since"))
    return G.nested(agents, ["stopped", "since"]).select("id", "parent", "root", "depth", "size", "place")


_R = with_views("ev") + ", e AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, k, event_type FROM ev)"
_BRANCH = _R + """, b AS (SELECT file, r AS id, CASE WHEN r = 0 THEN NULL WHEN r % 7 = 3 THEN greatest(0, r - 1 - k % 5) ELSE r - 1 END AS parent, r % 20 = 19 AS compaction, CASE WHEN r % 20 = 19 THEN r - 6 END AS first_kept, event_type = 'signup' AS system,
 CASE WHEN k % 3 = 0 THEN 'provider' || k % 2 END AS provider, CASE WHEN k % 4 = 0 THEN 'model' || k % 3 END AS model, CASE WHEN k % 9 = 0 THEN 'thinking' || k % 2 END AS thinking FROM e),
p AS (SELECT file, max(id) AS id, CAST(0 AS BIGINT) AS steps FROM b GROUP BY 1 UNION ALL SELECT p.file, b.parent, p.steps + 1 FROM p JOIN b ON b.file = p.file AND b.id = p.id WHERE b.parent IS NOT NULL),
q AS (SELECT b.*, p.steps FROM p JOIN b ON b.file = p.file AND b.id = p.id)"""

QUERIES = {
    "branch_paths": (_on_branch(G.paths_to), _BRANCH + " SELECT file, id, steps FROM p"),
    "branch_context": (
        _on_branch(G.context_entries),
        _BRANCH + """, c AS (SELECT file, arg_min(id, steps) AS c_id, min(steps) AS c_steps, arg_min(first_kept, steps) AS first_kept FROM q WHERE compaction GROUP BY 1),
d AS (SELECT c.*, q.steps AS kept_steps FROM c LEFT JOIN q ON q.file = c.file AND q.id = c.first_kept AND q.steps > c.c_steps), m AS (SELECT file, max(steps) AS most FROM q GROUP BY 1)
SELECT q.file, q.id, CASE WHEN q.id = c_id THEN 0 ELSE most - steps + 1 END AS place FROM q JOIN m USING (file) LEFT JOIN d USING (file) WHERE c_id IS NULL OR steps <= c_steps OR (steps <= kept_steps AND NOT system)""",
    ),
    "branch_route": (
        _on_branch(G.route_at),
        _BRANCH + " SELECT file, arg_min(provider, steps) FILTER (provider IS NOT NULL) AS provider, arg_min(model, steps) FILTER (model IS NOT NULL) AS model, arg_min(thinking, steps) FILTER (thinking IS NOT NULL) AS thinking FROM q GROUP BY 1",
    ),
    "context_after_restores": (
        lambda s, d: G.surface_after_restores(_restores(s, d)),
        _R + """, v AS (SELECT file, r, CASE WHEN r % 9 = 5 THEN r - 1 - k % 8 WHEN r % 9 = 6 AND k % 2 = 0 THEN r - 2 END AS restores FROM e),
w AS (SELECT file, max(r) AS r FROM v GROUP BY 1 UNION ALL SELECT w.file, coalesce(v.restores, v.r - 1) FROM w JOIN v ON v.file = w.file AND v.r = w.r WHERE coalesce(v.restores, v.r - 1) >= 0)
SELECT w.file, w.r AS seq FROM w JOIN v ON v.file = w.file AND v.r = w.r WHERE v.restores IS NULL""",
    ),
    "nested_calls": (
        lambda s, d: G.nested(_calls(s, d), ["started"]),
        _R + """, c AS (SELECT file, r AS id, CASE WHEN r % 11 > 0 THEN greatest(r - r % 11, r - 1 - k % 4) END AS parent, k * 1000000 + r AS own FROM e),
t AS (SELECT file, id, parent, id AS root, CAST(0 AS BIGINT) AS depth, [own] AS path FROM c WHERE parent IS NULL UNION ALL SELECT c.file, c.id, c.parent, t.root, t.depth + 1, list_append(t.path, c.own) FROM t JOIN c ON c.file = t.file AND c.parent = t.id)
SELECT file, id, parent, root, depth, (SELECT count(*) FROM t b WHERE b.file = t.file AND b.path[1:len(t.path)] = t.path) AS size, row_number() OVER (PARTITION BY file ORDER BY path) - 1 AS place FROM t""",
    ),
    "nested_family_page": (
        lambda s, d: G.family_page(G.nested(_calls(s, d), ["started"]), 5),
        _R + """, c AS (SELECT file, r AS id, CASE WHEN r % 11 > 0 THEN greatest(r - r % 11, r - 1 - k % 4) END AS parent, k * 1000000 + r AS own FROM e),
t AS (SELECT file, id, parent, id AS root, [own] AS path FROM c WHERE parent IS NULL UNION ALL SELECT c.file, c.id, c.parent, t.root, list_append(t.path, c.own) FROM t JOIN c ON c.file = t.file AND c.parent = t.id),
o AS (SELECT file, root, id, row_number() OVER (PARTITION BY file, root ORDER BY path) - 1 AS place, greatest(count(*) OVER (PARTITION BY file, root) - 5, 0) AS more FROM t) SELECT file, root, id, place, more FROM o WHERE place < 5""",
    ),
    "agent_walk": (
        _walk,
        with_views("v_tree") + """, t AS (SELECT a.id, a.parent, coalesce(b.parent, a.parent, a.id) AS root, CASE WHEN a.parent IS NULL THEN 0 WHEN b.parent IS NULL THEN 1 ELSE 2 END AS depth, row_number() OVER (PARTITION BY a.parent ORDER BY a.weight % 2 <> 0, -a.weight, a.id) AS own FROM v_tree a LEFT JOIN v_tree b ON b.id = a.parent),
o AS (SELECT a.*, CASE a.depth WHEN 0 THEN [a.own] WHEN 1 THEN [b.own, a.own] ELSE [c.own, b.own, a.own] END AS path FROM t a LEFT JOIN t b ON b.id = a.parent LEFT JOIN t c ON c.id = b.parent)
SELECT id, parent, root, CAST(depth AS BIGINT) AS depth, (SELECT count(*) FROM o x WHERE x.path[1:len(o.path)] = o.path) AS size, row_number() OVER (ORDER BY path) - 1 AS place FROM o""",
    ),
}
