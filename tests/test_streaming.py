"""Streams of files, and transcripts in JSON lines, on small inputs."""

from __future__ import annotations

import json

from logloom.operators.usage import usage_buckets
from logloom.sources.transcripts import message_requests, read_lines, up_to
from logloom.streaming.usage import file_stream, follow_buckets, followed_buckets

REQUESTS = "session string, kind string, model string, provider string, t_ms bigint, input bigint, output bigint, cache_read bigint, cache_write bigint, reasoning bigint, measured boolean"


def collected(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_stream_of_several_batches_and_a_restart_gives_the_batch_result(spark, tmp_path):
    rows = [(f"s{i % 3}", "k", "m", None if i % 2 else "p", 900_000 * (i % 4), i, 1, None, 2, 3, i % 5 > 0) for i in range(60)]
    every = spark.createDataFrame(rows, REQUESTS)
    source, into, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        follow_buckets(file_stream(spark, source, every.schema, 2), into, state).awaitTermination()

    every.limit(0).write.parquet(source)
    run()
    assert followed_buckets(spark, into).count() == 0
    spark.createDataFrame(rows[:40], REQUESTS).repartition(5).write.mode("append").parquet(source)
    run()
    spark.createDataFrame(rows[40:], REQUESTS).repartition(3).write.mode("append").parquet(source)  # late: times of buckets written before
    run()
    assert collected(followed_buckets(spark, into)) == collected(usage_buckets(every))
    assert spark.read.parquet(into).select("batch").distinct().count() > 2


def test_sibling_records_are_one_request_with_the_last_usage(spark, tmp_path):
    def said(request, t, usage, model="m"):
        return json.dumps({"type": "assistant", "requestId": request, "timestamp": f"2024-01-01T00:00:0{t}.5Z", "message": {"id": "x", "model": model, "usage": usage}})

    lines = [
        said("a", 1, {"input_tokens": 5, "output_tokens": 1}), json.dumps({"type": "user", "message": {"content": "hi"}}), said("b", 2, None), "no json", "", "[1]",
        said("a", 3, {"input_tokens": 5, "output_tokens": 9, "cache_read_input_tokens": 7, "output_tokens_details": {"thinking_tokens": 4}}, None), said(None, 4, {}),
    ]
    (tmp_path / "deep/er").mkdir(parents=True)
    (tmp_path / "deep/er/log.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "deep/other.txt").write_text(lines[0])
    got = {r["request"]: r.asDict() for r in message_requests(read_lines(spark, str(tmp_path))).collect()}
    pick = lambda r: [got[r][c] for c in ("session", "model", "t_ms", "measured", "input", "output", "cache_read", "cache_write", "reasoning")]
    assert pick("a") == ["log", "m", 1704067201500, True, 5, 9, 7, None, 4]
    assert pick("b") == ["log", "m", 1704067202500, False, None, None, None, None, None]
    assert pick("x") == ["log", "m", 1704067204500, True, 0, 0, None, None, None]
    assert len(got) == 3
    assert [r["value"] for r in up_to(read_lines(spark, str(tmp_path)), len(lines[0]) + 5).collect()] == [lines[0]]


def test_transcripts_feed_the_usage_buckets(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps({"type": "assistant", "uuid": "u", "timestamp": "bad", "message": {"usage": {"input_tokens": 3}}}))
    (r,) = usage_buckets(message_requests(read_lines(spark, str(tmp_path)))).collect()
    assert (r["session"], r["model"], r["time"], r["total"], r["measured"]) == ("s", "Unknown model", None, 3, 1)


def test_a_files_rows_are_made_without_casts(monkeypatch):
    import pandas as pd

    from logloom.streaming.ordered_fold import _Fold

    class New:
        exists = False

    f = _Fold(New())
    for seq, cat in enumerate(("system", "user", "assistant")):
        f.take(seq, cat, 5)
    f.release()
    f.take(0, "user", 1)
    monkeypatch.setattr(pd.DataFrame, "astype", None)
    monkeypatch.setattr(pd.DataFrame, "insert", None)
    made = f.rows("a")
    assert [str(t) for t in made.dtypes] in (["object", "int64", "object", "Int64", "Int64", "Int64", "Int64", "bool"], ["str", "int64", "str", "Int64", "Int64", "Int64", "Int64", "bool"])
    assert [[None if v is pd.NA else v for v in row] for row in made.values.tolist()] == [["a", 0, "system", 0, 0, 5, None, False], ["a", 1, "user", 1, 0, 10, 0, False], ["a", 2, "assistant", 1, 1, 15, 0, False], ["a", 0, "user", None, None, None, None, True]]
