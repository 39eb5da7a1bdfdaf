"""Settled lines, vetoed groups, run states, markup, packed streams, prompts and clocks, against walks written from their rules."""

from __future__ import annotations

import random
import re

from logloom.operators.clocks import message_clocks
from logloom.operators.graph import shared_object_edges, vetoed_components
from logloom.operators.markup import agent_mentions
from logloom.operators.packed import expand_runs
from logloom.operators.prompt import prompt_at, prompt_parts
from logloom.operators.runs import run_states
from logloom.operators.settling import newly_settled, settled_lines

# settled lines ---------------------------------------------------------------------------------

MESSAGES = "file string, message string, at long, role string, completed boolean, error boolean, seen boolean"
PARTS = "file string, message string, part string, type string, ended boolean, compaction boolean"


def settle_by_walk(messages, parts):
    out = set()
    for file in {m[0] for m in messages}:
        own = sorted((m for m in messages if m[0] == file), key=lambda m: (m[2], m[1]))
        for k, (_, mid, _, role, completed, error, seen) in enumerate(own):
            have = sorted((p for p in parts if p[:2] == (file, mid)), key=lambda p: p[2])
            later = own[k + 1 :]
            later_assistant, ended = any(x[3] == "assistant" for x in later), bool(completed or error)
            if role == "user":
                if any(p[5] for p in have):
                    s = next((n for n, x in enumerate(later) if x[3] == "assistant"), None)
                    if s is None or not (later[s][5] or any(x[3] == "assistant" for x in later[s + 1 :]) or (later[s][4] and seen)):
                        break
                elif not (later or (have and seen)):
                    break
            out.add((file, mid, 0, None))
            if role == "assistant":
                for n, p in enumerate(have):
                    own_end = p[4] if p[4] is not None else p[3] == "text" if p[3] in ("text", "reasoning", "tool") else True
                    if p[3] not in ("text", "reasoning", "tool"):
                        own_end = True
                    if not (ended or later_assistant or own_end):
                        break
                    out.add((file, mid, 1, p[2]))
                if ended:
                    out.add((file, mid, 2, None))
                elif not later_assistant:
                    break
            elif role != "user" and have:
                break
    return out


def test_settled_lines_equal_a_walk_and_only_grow(spark):
    r = random.Random(1)
    messages, parts = [], []
    for f in range(60):
        for k in range(r.randint(1, 6)):
            role = r.choice(["user", "assistant", "assistant", "system"])
            done = r.random() < 0.7
            messages.append((f"f{f}", f"m{k}", r.randint(0, 3) if f % 4 == 0 else k, role, done and r.random() < 0.8, done and r.random() < 0.2, r.random() < 0.5))
            for p in range(r.randint(0, 3)):
                parts.append((f"f{f}", f"m{k}", f"p{p}", r.choice(["text", "reasoning", "tool", "file"]), r.choice([None, True, False]), role == "user" and r.random() < 0.3))
    lines = settled_lines(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(parts, PARTS))
    assert {tuple(x)[:4] for x in lines.collect()} == settle_by_walk(messages, parts)
    done = [(*m[:4], True, False, True) for m in messages]
    final = settled_lines(spark.createDataFrame(done, MESSAGES), spark.createDataFrame(parts, PARTS))
    fresh = newly_settled(final, lines)
    assert {tuple(x)[:4] for x in fresh.collect()} == settle_by_walk(done, parts) - settle_by_walk(messages, parts)
    assert not settle_by_walk(messages, parts) - settle_by_walk(done, parts)
    assert settled_lines(spark.createDataFrame([], MESSAGES), spark.createDataFrame([], PARTS)).count() == 0


# vetoed groups ---------------------------------------------------------------------------------


def groups_by_union(strong, weak):
    parent = {v: v for e in [*strong, *weak] for v in e[:2] if v is not None}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    def union(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    for a, b, _ in strong:
        if a is not None and b is not None:
            union(a, b)
    vetoed = lambda v: any(x and a is not None and b is not None and find(a) == find(v) for a, b, x in strong)
    for a, b in weak:
        if a is not None and b is not None and find(a) != find(b) and not vetoed(a) and not vetoed(b):
            union(a, b)
    return {v: find(v) for v in parent}


def test_weak_edges_join_what_no_veto_holds_apart(spark):
    r = random.Random(2)
    for n in (1, 30, 60):
        strong = [(r.randrange(n), r.choice([None, r.randrange(n)]), r.random() < 0.1) for _ in range(n // 2)] + [(k, k + 1, False) for k in range(100, 140)]
        carriers = [(r.randrange(n + 50), r.choice([None, *"abcdefghij"])) for _ in range(n)]
        last, weak = {}, []
        for node, o in sorted(set(c for c in carriers if c[1] is not None)):
            if o in last:
                weak.append((last[o], node))
            last[o] = node
        edges = shared_object_edges(spark.createDataFrame(carriers, "node long, object string"))
        assert sorted(map(tuple, edges.collect())) == sorted(weak)
        got = vetoed_components(spark.createDataFrame(strong, "src long, dst long, vetoes boolean"), spark.createDataFrame(weak, "src long, dst long"))
        assert dict(map(tuple, got.collect())) == groups_by_union(strong, weak)


# run states ------------------------------------------------------------------------------------

EVENTS = "file string, call_id string, seq long, kind string, t_ms long, is_error boolean, said string, agent_id string, model string, description string"


def states_by_walk(events):
    calls = {}
    for file, call, seq, kind, t, bad, said, agent, model, about in sorted(events, key=lambda e: e[2]):
        if kind == "call":
            calls[file, call] = ["launching", None, None, model, about]
        c = calls.get((file, call))
        if c is None or kind == "call":
            continue
        c[2] = c[2] if c[2] is not None else agent
        if kind != "notice":
            c[3], c[4] = c[3] if c[3] is not None else model, c[4] if c[4] is not None else about
        if kind == "receipt" and c[0] == "launching":
            c[0] = "running"
        elif kind == "result" and c[1] is None:
            c[0], c[1] = "failed" if bad else "completed", t
        elif kind == "notice":
            c[0] = "completed" if said == "completed" else "stopped" if said in ("killed", "stopped", "cancelled", "canceled") else "failed"
            c[1] = t
    return {(f, c, *v) for (f, c), v in calls.items()}


def test_run_states_equal_a_walk(spark):
    r = random.Random(3)
    events = [("f", f"c{r.randrange(60)}", k, r.choice(["call", "call", "receipt", "result", "notice"]), 1000 + k, r.choice([None, True, False]), r.choice([None, "completed", "killed", "odd"]), r.choice([None, "a", "b"]), r.choice([None, "m", "n"]), r.choice([None, "d"])) for k in range(250)]
    assert {tuple(x) for x in run_states(spark.createDataFrame(events, EVENTS)).collect()} == states_by_walk(events)
    assert run_states(spark.createDataFrame([], EVENTS)).count() == 0


# markup ----------------------------------------------------------------------------------------


def mentions_by_walk(text):
    text = text or ""
    status = lambda w: "completed" if w == "completed" else "failed" if w in ("failed", "error") else "stopped" if w in ("aborted", "killed", "stopped", "cancelled", "canceled") else None
    if not text.lstrip().startswith("<agent_swarm_result>"):
        head = re.split(r"\n[ \t]*\n", text)[0]
        find = lambda n, k: next(iter(re.findall(rf"(?m)^[ \t]*{n}:[ \t]*({k})[ \t]*$", head)), None)
        agent = find("agent_id", r"\S+")
        return [] if agent is None else [(agent, None, find("actual_subagent_type", r"\S+"), status(find("status", r"\w+")))]
    text = text.strip()
    if not text.endswith("</agent_swarm_result>"):
        return []
    body, out, depth, open_ = text[len("<agent_swarm_result>") : -len("</agent_swarm_result>")], [], 0, None
    for m in re.finditer(r"<(/?)subagent\b([^>\n]*)>", body):
        if m[1]:
            if depth == 0:
                return []
            depth -= 1
            if depth == 0 and open_:
                out.append(open_)
                open_ = None
        else:
            depth += 1
            if depth != 1 or (m.start() > 0 and body[m.start() - 1] != "\n"):
                continue
            at = dict(re.findall(r'(\w+)="([^"]*)"', m[2]))
            plain = {k: v.replace("&quot;", '"').replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&") for k, v in at.items()}
            if plain.get("agent_id"):
                open_ = (plain["agent_id"], plain.get("item"), None, status(plain.get("outcome")))
    return out if depth == 0 else []


def test_mentions_equal_a_plain_parser(spark):
    r = random.Random(4)
    some = ["\n", "<subagent>", '<subagent agent_id="a1">', '\n<subagent agent_id="a2" item="x &amp; &lt;y" outcome="failed">', '\n<subagent agent_id="" item="n">', "</subagent>", "</subagent>\n", "text ", '<subagent item="agent_id=">', '\n<subagent agent_id="b" agent_id="c">', "<subagents>"]
    texts = [None, "", "agent_id: a\nstatus: completed", "x\n agent_id:\tq \n\nagent_id: no", "x\n\nagent_id: no", "agent_id: a b", "<agent_swarm_result>", "  <agent_swarm_result></agent_swarm_result>\n", "actual_subagent_type: t\nagent_id: z\nstatus: killed"]
    texts += ["<agent_swarm_result>" + "".join(r.choices(some, k=r.randint(0, 9))) + "</agent_swarm_result>" for _ in range(400)]
    grow = lambda depth: "".join(r.choice(some[1:5]) + grow(depth - 1) + "</subagent>" for _ in range(r.randint(0, 3))) if depth else ""
    texts += [f"<agent_swarm_result>{grow(r.randint(1, 3))}</agent_swarm_result>" for _ in range(120)]
    texts += ["<agent_swarm_result>" + "".join(f'\n<subagent agent_id="k{k}">' + "<subagent></subagent>" * (k % 3) + "</subagent>" for k in range(200)) + "</agent_swarm_result>"]
    got = {}
    for x in agent_mentions(spark.createDataFrame(list(enumerate(texts)), "n long, text string")).collect():
        got.setdefault(x["n"], []).append((x["place"], x["agent_id"], x["description"], x["agent_type"], x["status"]))
    want = {n: [(k, *m) for k, m in enumerate(mentions_by_walk(t))] for n, t in enumerate(texts)}
    assert {n: sorted(v) for n, v in got.items()} == {n: v for n, v in want.items() if v} and len(got) > 60


# packed streams --------------------------------------------------------------------------------


def test_packed_runs_equal_adding_up_the_gaps(spark):
    r = random.Random(5)
    runs = [(f"f{k % 7}", r.choice(["text-chunks", "tool-call-chunks", "reasoning-chunks"]), r.choice([None, 100 * k]), r.choice([None, 1000 * k, 1000 * k]), r.choice([None, 2]), 1, 2, r.choice([None, "c"]), r.choice([None, "n"]),
             r.choice([None, [r.choice([None, "a", "b"]) for _ in range(r.randint(0, 6))]]), r.choice([None, [r.choice([None, 1, 2, 3, 4]) for _ in range(r.randint(0, 6))]])) for k in range(300)]
    want = []
    for f, kind, seq0, time0, index, turn, step, call, name, texts, dt in runs:
        if time0 is None:
            continue
        t = time0
        for k, x in enumerate(texts or []):
            if k:
                if k > len(dt or []) or dt[k - 1] is None:
                    break
                t += dt[k - 1]
            tool = kind == "tool-call-chunks"
            want.append((f, (seq0 or 0) + k, t, {"text-chunks": "text-delta", "tool-call-chunks": "tool-call-delta"}.get(kind, "reasoning-delta"), index or 0, x or "", (call or "") if tool else None, name if tool and k == 0 else None, turn, step))
    df = spark.createDataFrame(runs, "file string, type string, seq0 long, time0 long, index long, turn long, step long, call_id string, name string, texts array<string>, dt array<long>")
    assert sorted(map(str, map(tuple, expand_runs(df).collect()))) == sorted(map(str, want)) and len(want) > 100
    assert expand_runs(df.where("false")).count() == 0


# prompts ---------------------------------------------------------------------------------------

PATCHES = "file string, seq long, texts array<string>, sections array<struct<name: string, value: string>>, removed array<string>, added array<struct<name: string, value: string>>"


def test_prompts_equal_patching_step_by_step(spark):
    r = random.Random(6)
    patches, want = [], set()
    for f in range(12):
        texts, sections, tools = [], {}, {}
        for seq in range(25):
            if r.random() < 0.5:
                p = ([r.choice(["", f"t{seq}"]) for _ in range(r.randint(0, 2))], [(n, r.choice([None, "", f"{n}{seq}"])) for n in r.sample("wxyz", r.randint(0, 3))], [r.choice(["a", "b", "c", "q"]) for _ in range(r.randint(0, 2))], [(r.choice([*"abc", None]), f"d{seq}") for _ in range(r.randint(0, 3))])
                patches.append((f"f{f}", seq, *(x if r.random() < 0.9 else None for x in p)))
                t, s, gone, new = patches[-1][2:]
                texts += [x for x in t or [] if x]
                for n, v in s or []:
                    sections.pop(n, None) if v is None else sections.__setitem__(n, v)
                for n in gone or []:
                    tools.pop(n, None)
                for n, v in new or []:
                    if n is not None:
                        tools[n] = v
            want.add((f"f{f}", seq, "\n\n".join([*texts, *[v for v in sections.values() if v]]), tuple(tools)))
    steps = spark.createDataFrame([(f"f{f}", s) for f in range(12) for s in range(25)], "file string, seq long")
    got = prompt_at(prompt_parts(spark.createDataFrame(patches, PATCHES)), steps).collect()
    assert {(x["file"], x["seq"], x["system"], tuple(x["tools"])) for x in got} == want
    none = prompt_at(prompt_parts(spark.createDataFrame([], PATCHES)), steps)
    assert none.where("system = '' AND size(tools) = 0").count() == 300


# clocks ----------------------------------------------------------------------------------------


def clocks_by_walk(messages, session, turns, items):
    created, updated, last_time = session
    usable = any(p is not None for _, _, p in turns) or any(s is not None or e is not None for *_, s, e in items)
    out, floor, turn, cursor, asked = [], last_time, -1, 0, None
    for k, (kind, request, calls) in enumerate(messages):
        stay = created if floor is None else floor
        own = sorted((i for i in items if i[0] == turn), key=lambda i: i[1])
        raw = stay
        if not usable:
            raw = created if k == 0 else max(created, updated)
        elif kind in ("system", "injection"):
            raw = created
        elif kind == "human":
            same = bool(request) and request == asked and turn >= 0
            found = None
            if not same and request:
                found = next((t for t, q, _ in sorted(turns) if t >= max(0, turn) and q == request), None)
                if found is not None:
                    turn, cursor = found, 0
            asked = request
            if same or not request or found is not None:
                prompt = next((p for t, _, p in turns if t == turn), None)
                first = next((i[4] for i in sorted(i for i in items if i[0] == turn) if i[4] is not None), None)
                raw = first if same and first is not None and (prompt is None or first >= prompt) else prompt
                raw = stay if raw is None else raw
        elif kind == "assistant":
            start = None
            if calls:
                taken = [(n, i) for n, i in enumerate(own) if n >= cursor and i[2] == "tool" and i[3] in calls]
                starts = [i[4] for _, i in taken if i[4] is not None]
                start = min(starts, default=None)
                if taken:
                    cursor = taken[-1][0] + 1
            else:
                n = next((n for n, i in enumerate(own) if n >= cursor and i[2] != "tool"), None)
                if n is not None:
                    start, cursor = own[n][4], n + 1
            raw = stay if start is None else start
        elif kind == "tool":
            end = next((i[5] for i in own if i[2] == "tool" and i[3] in calls), None)
            raw = stay if end is None else end
        floor = raw if floor is None else max(raw, floor)
        out.append(floor)
    return out


def test_clocks_equal_a_walk(spark):
    r = random.Random(7)
    messages, sessions, turns, items, want = [], [], [], [], {}
    for f in range(80):
        session = (1000, r.choice([900, 2000]), r.choice([None, None, 1100]))
        own_turns = [(t, f"q{t}", None if f % 9 == 0 or r.random() < 0.2 else 1000 + 100 * t + r.randint(-150, 50)) for t in range(r.randint(0, 4))]
        own_items, own = [], [(r.choice(["system", "injection"]), None, [])] if r.random() < 0.5 else []
        for t, q, _ in own_turns:
            if r.random() < 0.9:
                own.append(("human", r.choice([q, q, q, None, "none", f"q{r.randint(0, 3)}"]), []))
            n = 0
            for _ in range(r.randint(0, 4)):
                clock = lambda: None if f % 9 == 0 or r.random() < 0.2 else 1000 + 100 * t + 10 * n + r.randint(-20, 20)  # noqa: E731, B023
                if r.random() < 0.5:
                    for _ in range(r.randint(0, 2)):
                        own_items.append((t, n, r.choice(["text", "thinking"]), None, clock(), clock()))
                        n += 1
                    ids = [f"c{t}.{n + k}" for k in range(r.randint(1, 2))]
                    for c in ids:
                        own_items.append((t, n, "tool", c, clock(), clock()))
                        n += 1
                    own.append(("assistant", None, ids))
                    own += [("tool", None, [c]) for c in ids if r.random() < 0.8]
                else:
                    if r.random() < 0.8:
                        own_items.append((t, n, r.choice(["text", "thinking"]), None, clock(), clock()))
                        n += 1
                    own.append(("assistant", None, []))
            if r.random() < 0.3:
                own.append(("human", q, []))
        messages += [(f, s, *m) for s, m in enumerate(own)]
        sessions.append((f, *session))
        turns += [(f, *t) for t in own_turns]
        items += [(f, *i) for i in own_items]
        want |= {(f, s): t for s, t in enumerate(clocks_by_walk(own, session, own_turns, own_items))}
    got = message_clocks(
        spark.createDataFrame(messages, "file long, seq long, kind string, request_id string, call_ids array<string>"), spark.createDataFrame(sessions, "file long, created_at long, updated_at long, last_time long"),
        spark.createDataFrame(turns, "file long, turn long, request_id string, prompt_time long"), spark.createDataFrame(items, "file long, turn long, item long, kind string, call_id string, start long, end long"),
    )
    found = {(x["file"], x["seq"]): x["t_ms"] for x in got.collect()}
    wrong = {k for k in want if want[k] != found.get(k)}
    assert len(found) == len(messages) and not wrong, [(f, [m[2:] for m in messages if m[0] == f], [t[1:] for t in turns if t[0] == f], [i[1:] for i in items if i[0] == f], [want[f, s] for s in range(99) if (f, s) in want], [found[f, s] for s in range(99) if (f, s) in want]) for f, _ in sorted(wrong)[:1]]
