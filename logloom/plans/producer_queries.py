"""Queries over what producers write beside plain records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.clocks import message_clocks
from logloom.operators.graph import shared_object_edges, vetoed_components
from logloom.operators.markup import agent_mentions
from logloom.operators.packed import expand_runs
from logloom.operators.prompt import prompt_at, prompt_parts
from logloom.operators.runs import run_states
from logloom.operators.settling import settled_lines
from logloom.sources.views import epoch_ms, message_view, table, turn_view, with_views


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _settled(spark, sf_dir) -> DataFrame:
    """Messages of which some have not ended, with up to two parts each."""
    file, seq = F.col("file"), F.col("seq")
    m = message_view(spark, sf_dir)
    messages = m.select("file", seq.alias("message"), seq.alias("at"), F.col("cat").alias("role"), ((file + seq) % 4 < 3).alias("completed"), ((3 * file + seq) % 11 == 0).alias("error"), (seq % 2 == 0).alias("seen"))
    part = F.col("part")
    each = m.select("file", seq.alias("message"), F.col("cat").alias("role"), F.explode(F.sequence(F.lit(0), F.length("text") % 3)).alias("part")).where("part > 0")
    kind = F.element_at(F.array(F.lit("text"), F.lit("reasoning"), F.lit("tool")), ((F.col("message") + part) % 3 + 1).cast("int"))
    parts = each.select("file", "message", part, kind.alias("type"), ((file + part) % 3 > 0).alias("ended"), ((F.col("role") == "user") & (F.col("message") % 5 == 0) & (part == 1)).alias("compaction"))
    return settled_lines(messages, parts)


_SETTLED = with_views("v_msg") + """, m AS (SELECT file, seq AS message, cat AS role, (file + seq) % 4 < 3 OR (3 * file + seq) % 11 = 0 AS ended, (3 * file + seq) % 11 = 0 AS failed, seq % 2 = 0 AS seen, length(text) % 3 AS n FROM v_msg),
p AS (SELECT file, message, unnest(range(1, n + 1)) AS part FROM m), a AS (SELECT *, EXISTS (SELECT 1 FROM m x WHERE x.file = m.file AND x.message > m.message) AS later, EXISTS (SELECT 1 FROM m x WHERE x.file = m.file AND x.message > m.message AND x.role = 'assistant') AS la,
 (SELECT min(x.message) FROM m x WHERE x.file = m.file AND x.message > m.message AND x.role = 'assistant') AS sm FROM m),
h AS (SELECT a.*, CASE WHEN a.role <> 'user' THEN true WHEN a.n > 0 AND a.message % 5 = 0 THEN coalesce(s.failed OR s.la OR (s.ended AND a.seen), false) ELSE a.later OR (a.n > 0 AND a.seen) END AS header FROM a LEFT JOIN a s ON s.file = a.file AND s.message = a.sm),
c AS (SELECT *, CASE role WHEN 'user' THEN header WHEN 'assistant' THEN ended OR la ELSE n = 0 END AS closed FROM h), g AS (SELECT * FROM c WHERE header AND NOT EXISTS (SELECT 1 FROM c x WHERE x.file = c.file AND x.message < c.message AND NOT x.closed)),
k AS (SELECT g.file, g.message, p.part, g.ended OR g.la OR (g.file + p.part) % 3 > 0 AS ok FROM g JOIN p ON p.file = g.file AND p.message = g.message WHERE g.role = 'assistant')
SELECT file, message, 0 AS level, NULL AS part, message AS "at" FROM g UNION ALL SELECT file, message, 2, NULL, message FROM g WHERE role = 'assistant' AND ended
UNION ALL SELECT file, message, 1, CAST(part AS INTEGER), message FROM k WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.file = k.file AND x.message = k.message AND x.part <= k.part AND NOT x.ok)"""


def _vetoed(spark, sf_dir) -> DataFrame:
    """Customers that follow another by its number, some of whom take part in nothing else, and some that share an object."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    strong = c.where("id % 3 = 0").select(F.col("id").alias("src"), F.floor(F.col("id") / 2).alias("dst"), (F.col("id") % 50 == 0).alias("vetoes"))
    return vetoed_components(strong, shared_object_edges(c.where("id % 4 = 1").select(F.col("id").alias("node"), _text("o", F.floor(F.col("id") / 40)).alias("object"))))


_VETOED = """WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey // 2 AS b, c_custkey % 50 = 0 AS veto FROM customer WHERE c_custkey % 3 = 0),
w AS (SELECT lag(c_custkey) OVER (PARTITION BY c_custkey // 40 ORDER BY c_custkey) AS a, c_custkey AS b FROM customer WHERE c_custkey % 4 = 1),
v AS (SELECT a AS x FROM e UNION SELECT b FROM e UNION SELECT a FROM w WHERE a IS NOT NULL UNION SELECT b FROM w WHERE a IS NOT NULL), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT x, x AS y FROM v UNION SELECT r.x, s.b FROM r JOIN s ON s.a = r.y), g AS (SELECT x, min(y) AS c FROM r GROUP BY 1), bad AS (SELECT DISTINCT g.c FROM e JOIN g ON g.x = e.a WHERE veto),
l AS (SELECT p.c AS a, q.c AS b FROM w JOIN g p ON p.x = w.a JOIN g q ON q.x = w.b WHERE p.c NOT IN (SELECT c FROM bad) AND q.c NOT IN (SELECT c FROM bad)), t AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
z AS (SELECT DISTINCT c AS x, c AS y FROM g UNION SELECT z.x, t.b FROM z JOIN t ON t.a = z.y), y AS (SELECT x, min(y) AS c FROM z GROUP BY 1)
SELECT g.x AS vertex, y.c AS component FROM g JOIN y ON y.x = g.c"""


def _run_events(spark, sf_dir) -> DataFrame:
    """Five events to a call: started, and heard of in one way or another, some before they start."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), epoch_ms(F.col("ts")).alias("t_ms"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    at, k = F.col("seq") % 5, F.col("k")
    kind = F.when((at == 1) | ((at == 3) & (k % 8 == 0)), "call").when(k % 4 == 0, "receipt").when(k % 4 < 3, "result").when(k % 3 == 0, "notice").otherwise("receipt")
    said = F.when(k % 2 == 0, "killed").when(k % 5 == 0, "completed").when(k % 7 > 0, "timeout")
    return e.select(F.lit("log").alias("file"), _text("c", F.floor(F.col("seq") / 5)).alias("call_id"), "seq", kind.alias("kind"), "t_ms", (k % 3 == 1).alias("is_error"), said.alias("said"), F.when(k % 2 == 1, _text("a", k)).alias("agent_id"), F.when(k % 3 == 0, _text("m", k)).alias("model"), F.lit(None).cast("string").alias("description"))


_RUNS = with_views("ev") + """, e AS (SELECT 'c' || event_id // 5 AS call_id, event_id AS seq, t_ms, k, CASE WHEN event_id % 5 = 1 OR (event_id % 5 = 3 AND k % 8 = 0) THEN 'call' WHEN k % 4 = 0 THEN 'receipt' WHEN k % 4 < 3 THEN 'result' WHEN k % 3 = 0 THEN 'notice' ELSE 'receipt' END AS kind FROM ev),
b AS (SELECT call_id, max(seq) AS began FROM e WHERE kind = 'call' GROUP BY 1), o AS (SELECT e.* FROM e JOIN b ON b.call_id = e.call_id AND e.seq >= b.began),
r AS (SELECT call_id, arg_max(k, seq) FILTER (kind = 'notice') AS nk, arg_max(t_ms, seq) FILTER (kind = 'notice') AS nt, arg_min(k, seq) FILTER (kind = 'result') AS rk, arg_min(t_ms, seq) FILTER (kind = 'result') AS rt, bool_or(kind = 'receipt') AS runs,
 arg_min('a' || k, seq) FILTER (kind <> 'call' AND k % 2 = 1) AS agent_id, arg_min('m' || k, seq) FILTER (kind <> 'notice' AND k % 3 = 0) AS model FROM o GROUP BY 1)
SELECT 'log' AS file, call_id, CASE WHEN nk IS NOT NULL THEN CASE WHEN nk % 2 = 0 THEN 'stopped' WHEN nk % 5 = 0 THEN 'completed' ELSE 'failed' END WHEN rk IS NOT NULL THEN CASE WHEN rk % 3 = 1 THEN 'failed' ELSE 'completed' END WHEN runs THEN 'running' ELSE 'launching' END AS status,
 coalesce(nt, rt) AS ended_at, agent_id, model, CAST(NULL AS VARCHAR) AS description FROM r"""


def _mentions(spark, sf_dir) -> DataFrame:
    """Results with a head, and swarms of two members of whom one quotes another; one in three is cut off."""
    m = message_view(spark, sf_dir)
    head = _text("agent_id: a", F.col("seq"), "\nstatus: error\n\nagent_id: ", F.col("cat"), "\n")
    swarm = _text('<agent_swarm_result>\n<subagent agent_id="x', F.col("file"), '" item="a &lt; b" outcome="completed">\n<subagent agent_id="no">\n</subagent>\n</subagent>\n<subagent agent_id="y', F.col("seq"), '">\n')
    said = F.when(F.col("seq") % 2 == 0, head).when(F.col("file") % 3 == 0, _text(swarm, "</agent_swarm_result>")).otherwise(_text(swarm, "</subagent>\n</agent_swarm_result>\n"))
    return agent_mentions(m.select("file", "seq", said.alias("text"))).drop("text")


_MENTIONS = with_views("v_msg") + """ SELECT file, seq, 0 AS place, 'a' || seq AS agent_id, NULL AS description, CAST(NULL AS VARCHAR) AS agent_type, 'failed' AS status FROM v_msg WHERE seq % 2 = 0
UNION ALL SELECT file, seq, 0, 'x' || file, 'a < b', NULL, 'completed' FROM v_msg WHERE seq % 2 = 1 AND file % 3 > 0 UNION ALL SELECT file, seq, 1, 'y' || seq, NULL, NULL, NULL FROM v_msg WHERE seq % 2 = 1 AND file % 3 > 0"""


def _packed(spark, sf_dir) -> DataFrame:
    """The words of each message as a run; the gap after a word is its length, and missing after the longest ones."""
    words = F.split("text", " ")
    gaps = F.transform(words, lambda w: F.when(F.length(w) < 12, F.length(w)).cast("bigint"))
    kind = F.when(F.col("cat") == "assistant", "text-chunks").when(F.col("cat") == "user", "tool-call-chunks").otherwise("reasoning-chunks")
    return expand_runs(message_view(spark, sf_dir).select("file", kind.alias("type"), (F.col("seq") * 10_000).alias("seq0"), (F.col("file") * 1_000_000).alias("time0"), F.col("seq").alias("index"), F.lit(None).cast("bigint").alias("turn"), F.col("seq").alias("step"), F.col("cat").alias("call_id"), _text("n", F.col("seq")).alias("name"), words.alias("texts"), gaps.alias("dt")))


_PACKED = with_views("v_msg") + """, w AS (SELECT file, seq, cat, unnest(string_split(text, ' ')) AS text, unnest(range(0, len(string_split(text, ' ')))) AS k FROM v_msg),
s AS (SELECT *, coalesce(sum(length(text)) OVER b, 0) AS gone, coalesce(bool_or(length(text) >= 12) OVER b, false) AS cut FROM w WINDOW b AS (PARTITION BY file, seq ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT file, seq * 10000 + k AS seq, file * 1000000 + CAST(gone AS BIGINT) AS t_ms, CASE cat WHEN 'assistant' THEN 'text-delta' WHEN 'user' THEN 'tool-call-delta' ELSE 'reasoning-delta' END AS kind, seq AS index, text, CASE WHEN cat = 'user' THEN cat END AS call_id,
 CASE WHEN cat = 'user' AND k = 0 THEN 'n' || seq END AS name, CAST(NULL AS BIGINT) AS turn, seq AS step FROM s WHERE NOT cut"""


def _prompts(spark, sf_dir) -> DataFrame:
    """Each user's events as patches, but purchases, at which the prompt is read."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    k, pair = F.col("k"), lambda n, v: F.array(F.struct(n.alias("name"), v.alias("value")))
    patches = e.where("event_type <> 'purchase'").select(
        "file", "seq", F.when(k % 10 == 0, F.array(_text("c", F.col("seq")))).alias("texts"), pair(_text("s", k % 5), F.when(k % 7 > 0, _text("v", k))).alias("sections"),
        F.when(k % 4 == 0, F.array(_text("t", (k + 1) % 4))).alias("removed"), F.when(k % 3 == 0, pair(_text("t", k % 4), _text("d", k))).alias("added"),
    )
    return prompt_at(prompt_parts(patches), e.where("event_type = 'purchase'").select("file", "seq")).select("file", "seq", "system", F.array_join("tools", ",").alias("tools"))


_PROMPTS = with_views("ev") + """, e AS (SELECT user_id AS file, event_id AS seq, event_type, k FROM ev), c AS (
 SELECT file, seq, 1 AS level, 's' || k % 5 AS name, CASE WHEN k % 7 > 0 THEN 'v' || k END AS value, 0 AS phase FROM e WHERE event_type <> 'purchase'
 UNION ALL SELECT file, seq, 2, 't' || (k + 1) % 4, NULL, 0 FROM e WHERE event_type <> 'purchase' AND k % 4 = 0 UNION ALL SELECT file, seq, 2, 't' || k % 4, 'd' || k, 1 FROM e WHERE event_type <> 'purchase' AND k % 3 = 0),
l AS (SELECT *, value IS NOT NULL AND lag(value) OVER o IS NULL AS begins, lead(seq) OVER o AS til FROM c WINDOW o AS (PARTITION BY file, level, name ORDER BY seq, phase)),
b AS (SELECT *, max(CASE WHEN begins THEN seq * 2 + phase END) OVER (PARTITION BY file, level, name ORDER BY seq, phase) AS born FROM l),
h AS (SELECT file, level, name, value, born, seq AS since, til FROM b WHERE value IS NOT NULL AND (til IS NULL OR til > seq) UNION ALL SELECT file, 0, NULL, 'c' || seq, seq * 2, seq, NULL FROM e WHERE event_type <> 'purchase' AND k % 10 = 0)
SELECT q.file, q.seq, coalesce(string_agg(h.value, chr(10) || chr(10) ORDER BY h.level, h.born) FILTER (h.level < 2), '') AS system, coalesce(string_agg(h.name, ',' ORDER BY h.born) FILTER (h.level = 2), '') AS tools
FROM (SELECT file, seq FROM e WHERE event_type = 'purchase') q LEFT JOIN h ON h.file = q.file AND h.since <= q.seq AND (h.til IS NULL OR h.til > q.seq) GROUP BY 1, 2"""


def _clocks(spark, sf_dir) -> DataFrame:
    """Conversations whose turns name a time of the prompt but for one in four; every assistant's message has one item, a call or a text."""
    m = turn_view(spark, sf_dir)
    file, seq, turn = F.col("file"), F.col("seq"), F.col("turn")
    call = (F.col("cat") == "assistant") & (seq % 2 == 1)
    kind = F.when(F.col("cat") == "user", "human").otherwise(F.col("cat"))
    messages = m.select("file", "seq", kind.alias("kind"), F.when(F.col("cat") == "user", _text("q", turn)).alias("request_id"), F.when(call, F.array(_text("c", seq))).otherwise(F.array().cast("array<string>")).alias("call_ids"))
    sessions = m.groupBy("file").agg(F.lit(1000).cast("bigint").alias("created_at"), F.lit(9000).cast("bigint").alias("updated_at"), F.max(F.when(file % 5 == 0, 1500)).cast("bigint").alias("last_time"))
    turns = m.where("cat = 'user'").select("file", "turn", _text("q", turn).alias("request_id"), F.when((file + turn) % 4 > 0, 1000 + turn * 100 + file % 7 * 30).alias("prompt_time"))
    item = F.row_number().over(Window.partitionBy("file", "turn").orderBy("seq")).cast("bigint")
    start = F.when(seq % 3 > 0, 1000 + seq * 70 - file % 11 * 20)
    items = m.where("cat = 'assistant' AND turn > 0").select("file", "turn", item.alias("item"), F.when(call, "tool").otherwise("text").alias("kind"), F.when(call, _text("c", seq)).alias("call_id"), start.alias("start"), (start + 5).alias("end"))
    return message_clocks(messages, sessions, turns, items)


_CLOCKS = with_views("v_turn") + """, u AS (SELECT file, bool_or((cat = 'user' AND (file + turn) % 4 > 0) OR (cat = 'assistant' AND turn > 0 AND seq % 3 > 0)) AS usable FROM v_turn GROUP BY 1),
r AS (SELECT t.file, t.seq, CASE WHEN NOT usable THEN CASE WHEN row_number() OVER (PARTITION BY t.file ORDER BY seq) = 1 THEN 1000 ELSE 9000 END WHEN cat = 'system' THEN 1000 WHEN cat = 'user' AND (t.file + turn) % 4 > 0 THEN 1000 + turn * 100 + t.file % 7 * 30
 WHEN cat = 'assistant' AND turn > 0 AND seq % 3 > 0 THEN 1000 + seq * 70 - t.file % 11 * 20 END AS raw, CASE WHEN t.file % 5 = 0 THEN 1500 END AS last_time FROM v_turn t JOIN u ON u.file = t.file),
k AS (SELECT file, seq, last_time, CASE WHEN raw IS NULL AND last_time IS NULL AND max(raw) OVER (PARTITION BY file ORDER BY seq) IS NULL THEN 1000 ELSE raw END AS raw FROM r)
SELECT file, seq, CAST(greatest(max(raw) OVER (PARTITION BY file ORDER BY seq), last_time) AS BIGINT) AS t_ms FROM k"""

QUERIES = {
    "settled_lines": (_settled, _SETTLED),
    "vetoed_groups": (_vetoed, _VETOED),
    "run_states": (lambda s, d: run_states(_run_events(s, d)), _RUNS),
    "agent_mentions": (_mentions, _MENTIONS),
    "packed_streams": (_packed, _PACKED),
    "prompt_at_steps": (_prompts, _PROMPTS),
    "message_clocks": (_clocks, _CLOCKS),
}
