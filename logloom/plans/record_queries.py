"""Queries over calls, lineage and registry prices, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators import calls as C
from logloom.operators import lineage as L
from logloom.operators import registry_prices as R
from logloom.sources.views import bill_view, message_view, page_view, table, tree_view, turn_view, with_views

_EV = with_views("ev")
_MSG = with_views("v_msg")


def _text(*parts) -> Column:
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def _call_view(spark, sf_dir) -> DataFrame:
    """Tool calls of each user, with arguments as producers write them: in any order, with and without blanks."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    kind = F.col("seq") % 7
    file_path = _text("src/f", _s("k"), ".py")
    args = (
        F.when(kind == 0, _text('{"path":"', file_path, '","limit":5}')).when(kind == 1, _text('{ "limit": 5, "path": "', file_path, '" }')).when(kind == 2, _text('{"content":"a\\nb\\n","file_path":"', file_path, '"}'))
        .when(kind == 3, _text('{"path":"', file_path, '","old_string":"x","new_string":"y\\nz"}')).when(kind == 4, _text('{"pattern":"f', _s("k"), '"}')).when(kind == 5, _text("not json ", _s("k"))).otherwise("{}")
    )
    tool = F.when(kind < 2, "read").when(kind == 2, "write").when(kind == 3, "edit").when(kind == 4, "grep").when(kind == 5, "bash").otherwise(_text("mcp__srv_", _s("k"), "__run"))
    matched = F.when((kind == 4) & (F.col("k") % 2 == 0), F.array(file_path, F.lit("src/all.py")))
    return e.select("file", "seq", "k", tool.alias("tool"), args.alias("args"), matched.alias("matched"))


_CALL = """v_call AS (SELECT user_id AS file, event_id AS seq, k, event_id % 7 AS kind, 'src/f' || k || '.py' AS p,
 CASE WHEN event_id % 7 < 2 THEN 'read' WHEN event_id % 7 = 2 THEN 'write' WHEN event_id % 7 = 3 THEN 'edit' WHEN event_id % 7 = 4 THEN 'grep' WHEN event_id % 7 = 5 THEN 'bash' ELSE 'mcp__srv_' || k || '__run' END AS tool FROM ev)"""
_CALLS = _EV + ", " + _CALL
_KEY = """CASE kind WHEN 0 THEN '{"limit":5,"path":"' || p || '"}' WHEN 1 THEN '{"limit":5,"path":"' || p || '"}' WHEN 2 THEN '{"content":"a\\nb\\n","file_path":"' || p || '"}' WHEN 3 THEN '{"new_string":"y\\nz","old_string":"x","path":"' || p || '"}' WHEN 4 THEN '{"pattern":"f' || k || '"}' WHEN 5 THEN 'not json ' || k ELSE '{}' END"""


def _fork_view(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each conversation forks the one before: its first records are copies of the parent's."""
    m = message_view(spark, sf_dir).select("file", "seq", F.concat("cat", F.lit(":"), "text").alias("own"))
    parent = m.select((F.col("file") + 1).alias("file"), "seq", F.col("own").alias("copied"))
    forks = m.join(parent, ["file", "seq"], "left").select("file", (F.col("file") - 1).alias("parent"), "seq", F.sha2(F.when(F.col("seq") < F.col("file") % 4, F.coalesce("copied", "own")).otherwise(F.col("own")), 256).alias("print"))
    return forks, m.select("file", "seq", F.sha2("own", 256).alias("print"))


_FORK = """, m AS (SELECT file, seq, cat || ':' || text AS own FROM v_msg),
fk AS (SELECT a.file, a.file - 1 AS parent, a.seq, sha256(CASE WHEN a.seq < a.file % 4 THEN coalesce(b.own, a.own) ELSE a.own END) AS print FROM m a LEFT JOIN m b ON b.file = a.file - 1 AND b.seq = a.seq),
fi AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq) AS i FROM fk), pn AS (SELECT file, seq, sha256(own) AS print FROM m),
w AS (SELECT file, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS pos FROM fi GROUP BY file
 UNION ALL SELECT w.file, w.i + 1, min(pn.seq) FROM w JOIN fi ON fi.file = w.file AND fi.i = w.i + 1 JOIN pn ON pn.file = fi.parent AND pn.print = fi.print AND pn.seq > w.pos GROUP BY w.file, w.i)
SELECT file, seq, print FROM fi WHERE i > (SELECT max(w.i) FROM w WHERE w.file = fi.file)"""


def _nodes(spark, sf_dir) -> DataFrame:
    """Messages as nodes of a context: every fifth is a tool result, system messages compact, some prune or undo."""
    m = message_view(spark, sf_dir)
    cat = F.when(F.col("tokens") % 5 == 0, "tool").otherwise(F.col("cat"))
    return m.select(
        "file", F.col("seq").cast("bigint").alias("seq"), cat.alias("cat"), F.when(F.col("tokens") % 3 == 0, 0).otherwise(F.col("tokens")).alias("tokens"), (F.col("cat") == "system").alias("kept"), ((F.col("file") + F.col("seq")) % 4 == 3).alias("compacts"),
        ((F.col("cat") == "assistant") & (F.col("tokens") % 2 == 0)).alias("prunes"), F.when((F.col("file") % 3 == 0) & (F.col("seq") % 3 == 2), (F.col("seq") - 2).cast("bigint")).alias("undoes_to"),
    )


_NODE = """, n AS (SELECT file, CAST(seq AS BIGINT) AS seq, CASE WHEN tokens % 5 = 0 THEN 'tool' ELSE cat END AS cat, CASE WHEN tokens % 3 = 0 THEN 0 ELSE tokens END AS tokens, cat = 'system' AS kept, (file + seq) % 4 = 3 AS compacts,
 cat = 'assistant' AND tokens % 2 = 0 AS prunes, CASE WHEN file % 3 = 0 AND seq % 3 = 2 THEN seq - 2 END AS undoes_to FROM v_msg)"""

def _case(table_: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table_.items()) + " END"


def _sql_tuple(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_TAG = "regexp_extract(t, '^\\s*<([A-Za-z][\\w-]*)[\\s>]', 1)"
_USER = ", u AS (SELECT file, seq, CASE WHEN seq % 5 = 4 THEN 'hook' WHEN seq % 5 = 3 THEN 'human' END AS origin, CASE seq % 4 WHEN 0 THEN '<system-reminder> ' WHEN 1 THEN '  <bash-input>' WHEN 2 THEN '<b> ' ELSE '' END || text AS t FROM v_msg)"
_PATHS = ", q AS (SELECT page_id, '/ws/' AS w, CASE page_id % 5 WHEN 0 THEN '/ws/' || path WHEN 1 THEN './' || path WHEN 2 THEN path WHEN 3 THEN 'C:/' || path ELSE '/other/' || path END AS p FROM v_page)"


def _injected(spark, sf_dir):
    m = message_view(spark, sf_dir)
    opening = F.when(F.col("seq") % 4 == 0, "<system-reminder> ").when(F.col("seq") % 4 == 1, "  <bash-input>").when(F.col("seq") % 4 == 2, "<b> ").otherwise("")
    origin = F.when(F.col("seq") % 5 == 4, "hook").when(F.col("seq") % 5 == 3, "human")
    return m.select("file", "seq", C.injected_user(origin, F.concat(opening, "text")).alias("injected"))


def _paths(spark, sf_dir):
    p, n = F.col("path"), F.col("page_id") % 5
    own = F.when(n == 0, _text("/ws/", p)).when(n == 1, _text("./", p)).when(n == 2, p).when(n == 3, _text("C:/", p)).otherwise(_text("/other/", p))
    return page_view(spark, sf_dir).select("page_id", C.absolute_path(own, F.lit("/ws/")).alias("absolute"), C.shown_path(own, F.lit("/ws/")).alias("shown"))


def _children(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("child"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey")).alias("tool_use_id"), F.when(F.col("s_suppkey") % 4 == 1, F.col("s_nationkey")).alias("agent_id"), F.when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("p"), _s("s_suppkey"))).alias("prompt"))
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("agent_id"), F.concat(F.lit("p"), _s("o_custkey")).alias("prompt"), (F.col("o_orderstatus") == "O").alias("pending"))
    return C.bound_children(s, calls)


def _family(spark, sf_dir):
    t = tree_view(spark, sf_dir)
    up = t.select(F.col("id").alias("up"), F.col("parent").alias("grand"))
    root = F.coalesce("grand", "parent", "id")
    depth = F.when(F.col("parent").isNull(), 0).when(F.col("grand").isNull(), 1).otherwise(2)
    return L.family_order(t.join(up, F.col("parent") == F.col("up"), "left").select(root.alias("root"), "id", "parent", depth.alias("depth"), (F.col("weight") % 2 == 0).alias("running"), F.col("weight").alias("updated")))


def _registry(spark, sf_dir):
    """The routes of all bills, models written in three ways, in a registry that each nation keeps of some parts' brands."""
    kind = F.col("cache_write") % 3
    model = F.when(kind == 0, _text("claude-", F.col("model"))).when(kind == 1, _text(F.col("model"), "[1m]")).otherwise(F.col("model"))
    pairs = bill_view(spark, sf_dir).select("provider", model.alias("model")).distinct()
    n, p = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    brand, way = F.col("p_brand"), F.col("p_partkey") % 4
    name = F.when(way == 0, brand).when(way == 1, F.upper(brand)).when(way == 2, _text("team-", brand)).otherwise(_text("claude-", brand))
    entries = n.join(p, F.col("p_partkey") % 25 == F.col("n_nationkey")).select(F.when(F.col("n_nationkey") % 5 == 0, "anthropic").otherwise(F.col("n_name")).alias("branch"), name.alias("name")).distinct()
    return R.registry_matches(pairs, entries)


QUERIES = {
    "call_argument_key": (lambda s, d: _call_view(s, d).select("seq", C.argument_key(F.col("args")).alias("key")), _CALLS + f" SELECT seq, {_KEY} AS key FROM v_call"),
    "call_rendered": (
        lambda s, d: _call_view(s, d).select("seq", C.rendered_call(F.col("tool"), F.col("args")).alias("shown")),
        _CALLS + " SELECT seq, tool || CASE WHEN kind < 2 THEN chr(10) || 'path: ' || p WHEN kind = 2 THEN chr(10) || 'content: a' || chr(10) || 'b' || chr(10) || chr(10) || 'file_path: ' || p WHEN kind = 3 THEN chr(10) || 'path: ' || p || chr(10) || 'old_string: x' || chr(10) || 'new_string: y' || chr(10) || 'z' WHEN kind = 4 THEN chr(10) || 'pattern: f' || k WHEN kind = 5 THEN chr(10) || 'not json ' || k ELSE '' END AS shown FROM v_call",
    ),
    "call_file_operations": (
        lambda s, d: C.file_operations(_call_view(s, d)),
        _CALLS + """ SELECT file, seq, CASE WHEN kind < 2 THEN 'read' WHEN kind = 2 THEN 'write' ELSE 'edit' END AS kind, p AS path, CAST(CASE kind WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 0 END AS BIGINT) AS added, CAST(CASE kind WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS removed, false AS pattern FROM v_call WHERE kind < 4
UNION ALL SELECT file, seq, 'search', 'f' || k, 0, 0, true FROM v_call WHERE kind = 4 UNION ALL SELECT file, seq, 'search', unnest([p, 'src/all.py']), 0, 0, false FROM v_call WHERE kind = 4 AND k % 2 = 0""",
    ),
    "call_sources": (lambda s, d: _call_view(s, d).groupBy("tool", C.mcp_server(F.col("tool")).alias("server")).agg(F.count(F.lit(1)).alias("n")), _CALLS + " SELECT tool, CASE WHEN kind = 6 THEN 'srv_' || k END AS server, count(*) AS n FROM v_call GROUP BY 1, 2"),
    "call_unpresented_results": (
        lambda s, d: C.unanswered_results(_call_view(s, d).where("seq % 3 = 0").select(F.col("seq").alias("call_id")), _call_view(s, d).where("seq % 2 = 1").select("file", "seq", (F.col("seq") - 1).alias("call_id"))).select("file", "seq"),
        _CALLS + " SELECT file, seq FROM v_call r WHERE seq % 2 = 1 AND NOT EXISTS (SELECT 1 FROM v_call c WHERE c.seq % 3 = 0 AND c.seq = r.seq - 1)",
    ),
    "call_children": (
        _children,
        """WITH c AS (SELECT o_orderkey AS call_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS agent_id, 'p' || o_custkey AS prompt, o_orderstatus = 'O' AS pending FROM orders)
SELECT s_suppkey AS child, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN (SELECT max(call_id) FROM c WHERE call_id = s_suppkey) END, CASE WHEN s_suppkey % 4 = 1 THEN (SELECT max(call_id) FROM c WHERE agent_id = s_nationkey) END, CASE WHEN s_suppkey % 4 = 2 THEN (SELECT max(call_id) FROM c WHERE prompt = 'p' || s_suppkey) END, (SELECT max(call_id) FROM c WHERE pending)) AS call_id FROM supplier""",
    ),
    "record_injected": (_injected, _MSG + _USER + f" SELECT file, seq, CASE WHEN origin IS NOT NULL AND origin <> 'human' THEN origin WHEN {_TAG} IN {_sql_tuple(C.INJECTED_TAGS)} THEN {_TAG} END AS injected FROM u"),
    "record_fingerprint": (
        lambda s, d: table(s, d, "events").select("event_id", F.sha2(F.to_json(F.try_parse_json("props")), 256).alias("print")),
        _EV + """ SELECT event_id, sha256('{"k":' || k || '}') AS print FROM ev""",
    ),
    "paths_shown": (
        _paths,
        with_views("v_page") + _PATHS + " SELECT page_id, CASE page_id % 5 WHEN 0 THEN p WHEN 2 THEN '/ws/' || p WHEN 3 THEN p WHEN 4 THEN p END AS absolute, CASE WHEN page_id % 5 = 0 THEN './' || substr(p, 5) WHEN page_id % 5 = 2 THEN './' || p ELSE p END AS shown FROM q",
    ),
    "fork_prefix_exclusion": (lambda s, d: L.own_records(*_fork_view(s, d)), _MSG + _FORK),
    "lineage_chain": (
        lambda s, d: L.chains(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when((F.col("c_custkey") % 2 == 1) & (F.col("c_custkey") > 1), F.floor(F.col("c_custkey") / 2)).when(F.col("c_custkey") % 4 == 2, F.floor(F.col("c_custkey") * 3 / 4)).alias("base"))),
        """WITH RECURSIVE l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 1 AND c_custkey > 1 THEN c_custkey // 2 WHEN c_custkey % 4 = 2 THEN c_custkey * 3 // 4 END AS base FROM customer),
r AS (SELECT id, id AS top, base, CAST(0 AS BIGINT) AS depth FROM l UNION ALL SELECT r.id, r.base, l.base, r.depth + 1 FROM r LEFT JOIN l ON l.id = r.base WHERE r.base IS NOT NULL)
SELECT id, top AS root, depth FROM r WHERE base IS NULL""",
    ),
    "lineage_newest_logs": (
        lambda s, d: L.newest_logs(table(s, d, "orders").select(F.col("o_custkey").alias("thread"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))),
        "SELECT thread, id, day AS \"at\" FROM (SELECT o_custkey AS thread, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    ),
    "lineage_own_records": (
        lambda s, d: message_view(s, d).withColumn("ordinal", F.when(F.col("seq") % 3 > 0, F.col("seq"))).where(F.col("ordinal").isNull() | (F.col("ordinal") >= F.col("file") % 4)).select("file", "seq"),
        _MSG + " SELECT file, seq FROM v_msg WHERE seq % 3 = 0 OR seq >= file % 4",
    ),
    "lineage_base_and_head": (
        lambda s, d: message_view(s, d).where("seq % 2 = 0").select("file", "seq", F.lit("base").alias("part")).unionByName(message_view(s, d).where("seq % 2 = 1").select("seq", "file", F.lit("head").alias("part"))),
        _MSG + " SELECT file, seq, CASE WHEN seq % 2 = 0 THEN 'base' ELSE 'head' END AS part FROM v_msg",
    ),
    "context_intervals": (
        lambda s, d: L.context_intervals(_nodes(s, d)),
        _MSG + _NODE + """, g AS (SELECT file, seq, cat, CASE WHEN NOT kept THEN (SELECT min(b.seq) FROM n b WHERE b.file = a.file AND b.seq > a.seq AND b.compacts) END AS c, CASE WHEN cat = 'tool' THEN (SELECT min(b.seq) FROM n b WHERE b.file = a.file AND b.seq > a.seq AND b.prunes) END AS p,
 (SELECT min(b.seq) FROM n b WHERE b.file = a.file AND b.seq > a.seq AND b.undoes_to <= a.seq) AS u FROM n a)
SELECT file, seq, cat, least(c, p, u) AS gone, CASE WHEN least(c, p, u) = c THEN 'compacted' WHEN least(c, p, u) = p THEN 'pruned' WHEN least(c, p, u) = u THEN 'undone' END AS reason FROM g""",
    ),
    "context_effective_system": (
        lambda s, d: L.effective_system(_nodes(s, d)),
        _MSG + _NODE + " SELECT file, seq, (SELECT max(b.seq) FROM n b WHERE b.file = n.file AND b.seq < n.seq AND b.cat = 'system' AND b.tokens > 0) AS system_seq FROM n",
    ),
    "context_items": (
        lambda s, d: L.context_items(_nodes(s, d)),
        _MSG + _NODE + " SELECT file, seq, cat, row_number() OVER (PARTITION BY file ORDER BY CASE cat WHEN 'system' THEN 0 WHEN 'tool' THEN 1 ELSE 2 END, seq) AS place FROM n",
    ),
    "turn_usage_apportioned": (
        lambda s, d: L.apportioned(turn_view(s, d).select("file", "turn", "seq", (F.length("text") % 11).cast("bigint").alias("weight"), (F.col("turn") * 997 + 13).cast("bigint").alias("total"))),
        with_views("v_turn") + """, w AS (SELECT file, turn, seq, length(text) % 11 AS weight, turn * 997 + 13 AS total FROM v_turn),
x AS (SELECT *, coalesce(total * weight // nullif(CAST(sum(weight) OVER (PARTITION BY file, turn) AS BIGINT), 0), 0) AS share, row_number() OVER (PARTITION BY file, turn ORDER BY seq DESC) AS back FROM w)
SELECT file, turn, seq, CAST(share + CASE WHEN back = 1 THEN total - sum(share) OVER (PARTITION BY file, turn) ELSE 0 END AS BIGINT) AS tokens FROM x""",
    ),
    "session_titles": (
        lambda s, d: table(s, d, "documents").select("doc_id", L.title_of(F.col("text")).alias("title")),
        "WITH l AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 80 THEN rtrim(left(t, 79)) || '…' ELSE t END AS title FROM l",
    ),
    "session_meta": (
        lambda s, d: L.session_meta(message_view(s, d)),
        _MSG + """, m AS (SELECT file, trim(regexp_replace(arg_min(text, seq) FILTER (cat = 'user'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS t, count(*) FILTER (cat = 'user') AS prompts, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS records FROM v_msg GROUP BY 1)
SELECT file, CASE WHEN length(t) > 80 THEN rtrim(left(t, 79)) || '…' ELSE t END AS title, prompts, first_seq, last_seq, records FROM m""",
    ),
    "session_child_merge": (
        lambda s, d: table(s, d, "customer").select("c_custkey", L.merged(F.when(F.col("c_custkey") % 3 == 0, F.lit("")).when(F.col("c_custkey") % 3 == 1, F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.lit("kept")).alias("label")),
        "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN c_name WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'kept' END AS label FROM customer",
    ),
    "session_vanished": (
        lambda s, d: table(s, d, "documents").select("source").distinct().exceptAll(table(s, d, "documents").where("doc_id % 40 < 13").select("source").distinct()),
        "SELECT DISTINCT source FROM documents EXCEPT SELECT source FROM documents WHERE doc_id % 40 < 13",
    ),
    "option_lists": (
        lambda s, d: table(s, d, "documents").select(F.explode(F.array(F.struct(F.lit("lang").alias("list"), F.col("lang").alias("name")), F.struct(F.lit("source").alias("list"), F.col("source").alias("name")))).alias("o")).select("o.list", "o.name").distinct(),
        "SELECT DISTINCT 'lang' AS list, lang AS name FROM documents UNION SELECT DISTINCT 'source', source FROM documents",
    ),
    "agent_family_order": (
        _family,
        with_views("v_tree") + """, t AS (SELECT a.id, a.parent, coalesce(b.parent, a.parent, a.id) AS root, CASE WHEN a.parent IS NULL THEN 0 WHEN b.parent IS NULL THEN 1 ELSE 2 END AS depth, row_number() OVER (PARTITION BY a.parent ORDER BY a.weight % 2 = 0 DESC, a.weight DESC, a.id) AS own FROM v_tree a LEFT JOIN v_tree b ON b.id = a.parent),
o AS (SELECT a.root, a.id, CASE a.depth WHEN 0 THEN [0, 0] WHEN 1 THEN [a.own, 0] ELSE [b.own, a.own] END AS path FROM t a LEFT JOIN t b ON b.id = a.parent)
SELECT root, place, id, more FROM (SELECT root, id, CAST(row_number() OVER (PARTITION BY root ORDER BY path) AS INTEGER) AS place, greatest(count(*) OVER (PARTITION BY root) - 25, 0) AS more FROM o) WHERE place <= 25""",
    ),
    "cost_registry_match": (
        _registry,
        with_views("v_bill") + f""", g AS (SELECT DISTINCT CASE WHEN n_nationkey % 5 = 0 THEN 'anthropic' ELSE n_name END AS branch, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN upper(p_brand) WHEN 2 THEN 'team-' || p_brand ELSE 'claude-' || p_brand END AS name FROM nation JOIN part ON p_partkey % 25 = n_nationkey),
p AS (SELECT DISTINCT provider, CASE WHEN cache_write % 3 = 0 THEN 'claude-' || model WHEN cache_write % 3 = 1 THEN model || '[1m]' ELSE model END AS model FROM v_bill),
a AS (SELECT provider, model, 0 AS way, model AS sought FROM p UNION ALL SELECT provider, model, 1, regexp_replace(model, '\\[[^\\]]*\\]\\s*$', '') FROM p),
m AS (SELECT a.*, g.* FROM a JOIN g ON lower(name) = lower(sought) OR ends_with(lower(name), '-' || lower(sought))),
f AS (SELECT provider, model, branch, way, coalesce(max(name) FILTER (name = sought), CASE WHEN count(DISTINCT lower(name)) = 1 THEN max(name) END) AS entry FROM m GROUP BY 1, 2, 3, 4),
h AS (SELECT provider, model, branch, arg_min(entry, way) AS entry FROM f WHERE entry IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT *, CASE WHEN branch = coalesce({_case(R.PROVIDER_IDS, 'provider')}, provider) THEN 0 WHEN branch = {_case(R.VENDORS, "split_part(lower(model), '-', 1)")} OR starts_with(lower(model), branch || '-') THEN 1 ELSE 2 END AS rank FROM h),
b AS (SELECT *, count(*) OVER (PARTITION BY provider, model) AS others, row_number() OVER (PARTITION BY provider, model ORDER BY rank, branch) AS place FROM k)
SELECT p.provider, p.model, b.branch AS entry_provider, b.entry FROM p LEFT JOIN b ON b.provider = p.provider AND b.model = p.model AND place = 1 AND (rank < 2 OR others = 1)""",
    ),
}
