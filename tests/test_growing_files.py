"""Streams: files that grow, are cut or replaced, and the ordered fold, across restarts."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from logloom.streaming.growing import SCHEMA, GrowingReader, current_lines, growing_lines
from logloom.streaming.ordered_fold import follow_in_order


class Follower:
    """Runs the stream until all is read, keeping each batch; every run is a restart."""

    def __init__(self, spark, tmp_path):
        self.spark, self.root, self.out, self.state = spark, tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
        self.root.mkdir()

    def run(self):
        keep = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("append").parquet(self.out)
        growing_lines(self.spark, str(self.root)).writeStream.option("checkpointLocation", self.state).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.schema(f"{SCHEMA}, batch int").parquet(self.out)

    def lines(self):
        return sorted((r["file"].rsplit("/", 1)[1], r["at"], r["value"]) for r in current_lines(self.run()).collect())


def test_lines_of_growing_cut_and_replaced_files(spark, tmp_path):
    f = Follower(spark, tmp_path)
    a, b = f.root / "a.jsonl", f.root / "sub" / "b.jsonl"
    b.parent.mkdir()
    a.write_bytes("one\n\ntwo é\nhal".encode())
    (f.root / "c.txt").write_text("not asked for\n")
    assert f.lines() == [("a.jsonl", 0, "one"), ("a.jsonl", 5, "two é")]
    a.open("ab").write(b"f\r\nopen")
    b.write_bytes(b"x\n")
    assert f.lines() == [("a.jsonl", 0, "one"), ("a.jsonl", 5, "two é"), ("a.jsonl", 12, "half"), ("b.jsonl", 0, "x")]
    assert f.run().count() == 4  # nothing twice
    a.write_bytes(b"one\nshort\n")  # cut short
    assert f.lines() == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "short"), ("b.jsonl", 0, "x")]
    b.write_bytes(b"replaced by more\nand more\n")  # longer than before, other bytes
    assert f.lines() == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "short"), ("b.jsonl", 0, "replaced by more"), ("b.jsonl", 17, "and more")]
    a.write_bytes(b"")
    assert f.lines() == [("b.jsonl", 0, "replaced by more"), ("b.jsonl", 17, "and more")]
    b.unlink()
    a.write_bytes(b"\xff\xfe\n")
    assert ("a.jsonl", 0, "��") in f.lines()


@pytest.mark.parametrize("split", [1, 2, 3, 7, 50])
def test_tasks_of_one_file_share_its_lines(tmp_path, split):
    r = random.Random(split)
    for _ in range(20):
        text = "".join(r.choices(["a", "bc", "\n", "\n\n", "é"], k=40)).encode()
        (tmp_path / "f.jsonl").write_bytes(text)
        reader = GrowingReader({"path": str(tmp_path), "split": str(split)})
        got = [tuple(x.values()) for p in reader.partitions({}, reader.latestOffset()) for b in reader.read(p) for x in b.to_pylist()]
        want, at = [], 0
        for line in text[: text.rfind(b"\n") + 1].split(b"\n")[:-1]:
            if line:
                want.append((str(tmp_path / "f.jsonl"), at, line.decode(), False))
            at += len(line) + 1
        assert got == want


FOLDED = "file long, seq long, cat string, tokens long"


def fold_by_walk(rows):
    out, files = set(), {}
    for f, s, c, t in sorted(rows):
        turn, step, tokens, system = files.get(f, (0, 0, 0, None))
        turn, step = (turn + 1, 0) if c == "user" else (turn, step + (c == "assistant"))
        tokens += t or 0
        out.add((str(f), s, c, turn, step, tokens, system, False))
        files[f] = turn, step, tokens, s if c == "system" else system
    return out


def test_fold_of_shuffled_batches_equals_the_walk(spark, tmp_path):
    r = random.Random(7)
    rows = [(f, s, r.choice(["user", "assistant", "system", "tool"]), r.choice([None, 1, 5, 9])) for f in range(7) for s in range(r.randint(1, 30))]
    shuffled = r.sample(rows, len(rows))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(4):
        spark.createDataFrame(shuffled[k::4], FOLDED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(FOLDED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        follow_in_order(stream, wait_ms=None).writeStream.option("checkpointLocation", state).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    got = [tuple(x) for x in spark.read.parquet(out).collect()]
    assert len(got) == len(rows) and set(got) == fold_by_walk(rows)


def test_a_gap_is_given_up_after_a_while_and_state_goes(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", 1), (1, 2, "assistant", 2), (1, 3, "user", 3), (2, 0, "user", 4), (None, 1, "user", 1)], FOLDED).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FOLDED).parquet(str(tmp_path / "in"))
    q = follow_in_order(stream, wait_ms=1500, forget_ms=1500).writeStream.format("memory").queryName("gaps").trigger(processingTime="300 milliseconds").start()
    rows = lambda: sorted(tuple(x) for x in spark.table("gaps").collect())
    try:
        deadline = time.time() + 90
        while time.time() < deadline and (len(rows()) < 4 or q.lastProgress["stateOperators"][0]["numRowsTotal"] > 0):
            time.sleep(0.3)
        assert rows() == [("1", 0, "user", 1, 0, 1, None, False), ("1", 2, "assistant", 1, 1, 3, None, False), ("1", 3, "user", 2, 0, 6, None, False), ("2", 0, "user", 1, 0, 4, None, False)]
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        q.stop()


def test_more_waiting_than_allowed_lets_a_gap_go_and_late_ones_are_named(spark, tmp_path):
    for part in ([(1, s, "user", 1) for s in range(5, 25)], [(1, 0, "user", 1), (1, 24, "user", 1), (1, 25, "assistant", 1)]):
        spark.createDataFrame(part, FOLDED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(FOLDED).parquet(str(tmp_path / "in"))
        follow_in_order(stream, wait_ms=None, most_held=10).writeStream.option("checkpointLocation", str(tmp_path / "s")).format("parquet").option("path", str(tmp_path / "o")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((tuple(x)[1:] for x in spark.read.parquet(str(tmp_path / "o")).collect()), key=lambda x: x[0])
    assert [x for x in got if x[-1]] == [(0, "user", None, None, None, None, True), (24, "user", None, None, None, None, True)]
    assert [x[0] for x in got if not x[-1]] == list(range(5, 26))
