"""Tool calls and what their arguments say: keys, labels, sources, paths and file operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arguments that describe a call.
SHOWN_ARGUMENTS = (
    "command", "cmd", "script", "description", "prompt", "subagent_type", "file_path", "filePath", "path", "target_file", "target_directory", "notebook_path", "pattern", "glob", "query", "search", "output_mode", "url",
    "old_string", "new_string", "oldString", "newString", "oldText", "newText", "content", "contents", "body", "message", "title", "plan", "todos", "edits", "glob_pattern", "tool_name", "tool_input", "task_id", "task_ids",
)
#: Tags of user records that no person typed.
INJECTED_TAGS = ("command-name", "command-message", "command-args", "local-command-stdout", "local-command-stderr", "local-command-caveat", "bash-input", "bash-stdout", "bash-stderr", "system-reminder", "task-notification")
#: What a tool does to files.
KINDS = {"read": "read", "read_image": "read", "write": "write", "edit": "edit", "glob": "search", "grep": "search"}
#: Longest rest of arguments that is shown where none of them describes the call.
REST_CHARS = 2048


def argument_key(args: Column) -> Column:
    """Arguments in one spelling: objects with sorted keys and no blanks; anything else as it is."""
    value = F.try_parse_json(args)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), F.to_json(value)).otherwise(args)


def rendered_call(tool: Column, args: Column) -> Column:
    """The tool's name and, a line each, the arguments that describe the call; else all of them if they are short."""
    entries = F.map_entries(F.from_json(args, "map<string,string>"))
    shown = F.transform(F.filter(entries, lambda e: e["key"].isin(*SHOWN_ARGUMENTS) & (F.coalesce(e["value"], F.lit("")) != "")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(args)).startswith("OBJECT"), F.lit(False))
    rest = F.when(is_object & ((F.size(entries) == 0) | (F.length(args) > REST_CHARS)), "").otherwise(F.coalesce(args, F.lit("")))
    tail = F.when(is_object & (F.size(shown) > 0), F.array_join(shown, "\n")).otherwise(rest)
    return F.when(tail != "", F.concat(tool, F.lit("\n"), tail)).otherwise(tool)


def injected_user(origin: Column, text: Column) -> Column:
    """What put a user's record in, or null for a person's: its origin, else a known tag that it opens with."""
    tag = F.regexp_extract(text, r"^\s*<([A-Za-z][\w-]*)[\s>]", 1)
    return F.when(origin.isNotNull() & (origin != "human"), origin).when(tag.isin(*INJECTED_TAGS), tag)


def mcp_server(tool: Column) -> Column:
    """The server of a proxied tool, mcp__<server>__<tool>; null for others."""
    server = F.regexp_extract(tool, "^mcp__(.*)__[^_]*(?:_[^_]+)*_?$", 1)
    return F.when(server != "", server)


_DRIVE = r"^[A-Za-z]:[\\/]"


def absolute_path(path: Column, workspace: Column) -> Column:
    """The path from the root; null for a relative one that has no workspace or begins with a dot."""
    whole = path.startswith("/") | path.rlike(_DRIVE)
    known = workspace.isNotNull() & (workspace != "") & ~path.startswith(".")
    return F.when(whole, path).when(known, F.concat(F.regexp_replace(workspace, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", "")))


def shown_path(path: Column, workspace: Column) -> Column:
    """The path as it is listed: ./ and the rest within the workspace; others outside of it as they are."""
    root = F.when(F.length(workspace) > 1, F.regexp_replace(workspace, "/+$", ""))
    inside = root.isNotNull() & path.startswith(F.concat(root, F.lit("/")))
    whole = path.startswith("/") | path.rlike(_DRIVE) | path.startswith(".")
    return F.when(path == root, "./").when(inside, F.concat(F.lit("./"), F.substring(path, F.length(root) + 2, F.length(path)))).when(whole, path).otherwise(F.concat(F.lit("./"), path))


def lines_of(text: Column) -> Column:
    """Lines of a text; one after the last break counts if it is not empty."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text.isNull() | (text == ""), 0).otherwise(breaks + F.when(text.endswith("\n"), 0).otherwise(1)).cast("bigint")


def file_operations(calls: DataFrame) -> DataFrame:
    """Columns file, seq, kind, path, added, removed, pattern: what each call did to which files.

    calls has file, seq, tool, args (JSON) and matched, the files that a search has hit (null
    where its result says nothing). A search gives one row for each hit file and one for its own
    target, unless that is the only hit; without a path its pattern is the target. Calls of other
    tools, and those whose arguments cannot be read, give none.
    """
    kind = F.coalesce(*[F.when(F.col("tool") == t, k) for t, k in KINDS.items()])
    arg = lambda k: F.get_json_object("args", f"$.{k}")
    path = F.coalesce(arg("path"), arg("file_path"))
    target = F.when(kind == "search", F.coalesce(F.when(path != "", path), arg("pattern"))).otherwise(path)
    pattern = (kind == "search") & (F.coalesce(path, F.lit("")) == "")
    added = F.when(kind == "write", lines_of(arg("content"))).when(kind == "edit", lines_of(arg("new_string"))).otherwise(0)
    removed = F.when(kind == "edit", lines_of(arg("old_string"))).otherwise(0)
    hits = F.transform(F.coalesce("matched", F.array().cast("array<string>")), lambda f: F.struct(f.alias("path"), F.lit(False).alias("pattern")))
    own = F.when(target.isNotNull() & ~F.coalesce(F.array_contains("matched", target), F.lit(False)), F.array(F.struct(target.alias("path"), pattern.alias("pattern")))).otherwise(F.array().cast("array<struct<path:string,pattern:boolean>>"))
    return (
        calls.where(kind.isNotNull()).select("file", "seq", kind.alias("kind"), added.cast("bigint").alias("added"), removed.cast("bigint").alias("removed"), F.explode(F.concat(own, hits)).alias("o"))
        .select("file", "seq", "kind", "o.path", "added", "removed", "o.pattern")
    )


def unanswered_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose call does not show them already."""
    return results.join(calls.select("call_id"), "call_id", "left_anti")


def bound_children(children: DataFrame, calls: DataFrame) -> DataFrame:
    """Columns child and call_id: the call that launched each child transcript.

    By the call's own id, else by the agent's id, else by the same prompt, else the newest call
    that nobody has answered; of several the newest. Each way is an aggregate of the calls and an
    equi-join, and children are bound apart from each other.
    """
    newest = lambda key, of=calls: of.groupBy(F.col(key).alias(f"by_{key}")).agg(F.max("call_id").alias(f"of_{key}"))
    pending = calls.where("pending").agg(F.max("call_id").alias("of_pending"))
    out = children.join(calls.select(F.col("call_id").alias("of_id")), F.col("tool_use_id") == F.col("of_id"), "left")
    out = out.join(newest("agent_id"), F.col("agent_id") == F.col("by_agent_id"), "left").join(newest("prompt"), (F.col("prompt") == F.col("by_prompt")) & (F.col("prompt") != ""), "left")
    return out.crossJoin(F.broadcast(pending)).select("child", F.coalesce("of_id", "of_agent_id", "of_prompt", "of_pending").alias("call_id"))
