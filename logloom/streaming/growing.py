"""Lines of files that grow, are cut short or are replaced, as a stream."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at bigint, value string, reset boolean"
#: Bytes before the end of what was read that tell whether a file is still the same.
TAIL = 256
#: Bytes read at a time, and bytes that one task reads of a file about.
CHUNK = 1 << 16
SPLIT = 64 << 20


@dataclass
class Stretch(InputPartition):
    """Lines that begin in [start, stop) of a file's bytes [begin, end), all of them whole; reset: say first that the file began anew."""

    file: str
    begin: int
    start: int
    stop: int
    end: int
    reset: bool


class GrowingReader(DataSourceStreamReader):
    """Offset: for each file the byte after its last line feed, and a digest of the bytes before.

    A file whose digest no longer holds at the old place was cut short or replaced, and is read again
    from its start. That is found out when a batch is planned, from the two offsets and the file, so a
    restart needs nothing but Spark's own checkpoint. The offset has an entry a file: meant for folders of
    up to some ten thousand files.
    """

    def __init__(self, options: dict[str, str]):
        self.root, self.pattern, self.split = options["path"], options.get("pattern", "*.jsonl"), int(options.get("split", SPLIT))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = self._open()
        out = {}
        for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.pattern):
                try:
                    with files.open_input_file(info.path) as f:
                        end = self._last_line_end(f, info.size)
                        out[info.path] = {"end": end, "tail": self._tail(f, end)}
                except FileNotFoundError:
                    continue  # gone since it was listed
        return dict(sorted(out.items()))

    @staticmethod
    def _last_line_end(f: pa.NativeFile, size: int) -> int:
        at = size
        while at > 0:
            begin = max(0, at - CHUNK)
            f.seek(begin)
            k = f.read(at - begin).rfind(b"\n")
            if k >= 0:
                return begin + k + 1
            at = begin
        return 0

    @staticmethod
    def _tail(f: pa.NativeFile, end: int) -> str:
        f.seek(max(0, end - TAIL))
        return blake2b(f.read(min(end, TAIL)), digest_size=12).hexdigest()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files, _ = self._open()
        out: list[InputPartition] = []
        for file, now in end.items():
            before = start.get(file)
            if before == now:
                continue
            begin, reset = before["end"] if before else 0, False
            if begin:
                with files.open_input_file(file) as f:
                    reset = now["end"] < begin or self._tail(f, begin) != before["tail"]
                begin = 0 if reset else begin
            edges = [*range(begin, now["end"], self.split), now["end"]]
            if reset and len(edges) == 1:
                edges.append(edges[0])
            out += [Stretch(file, begin, a, b, now["end"], reset and a == begin) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        p = partition
        files, _ = self._open()
        columns: list[list] = [[p.file], [-1], [None], [True]] if p.reset else [[], [], [], []]
        with files.open_input_file(p.file) as f:
            at, rest, size = p.start, b"", 0
            f.seek(at)
            if at > p.begin:  # the line that begins before is of the task before
                f.seek(at - 1)
                at, rest = at - 1, b""
                skip = True
            else:
                skip = False
            while at < p.stop or rest:
                got = f.read(min(CHUNK, p.end - at - len(rest))) if at + len(rest) < p.end else b""
                lines = (rest + got).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    begin, at = at, at + len(line) + 1
                    if skip:
                        skip = False
                        continue
                    if begin >= p.stop:
                        break
                    if line.strip():
                        for c, v in zip(columns, (p.file, begin, line.removesuffix(b"\r").decode("utf-8", "replace"), False), strict=True):
                            c.append(v)
                        size += len(line)
                if at >= p.stop or not got:
                    break
                if size > 4 << 20:
                    yield self._batch(columns)
                    columns, size = [[], [], [], []], 0
        yield self._batch(columns)

    @staticmethod
    def _batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["file", "at", "value", "reset"])


class GrowingLines(DataSource):
    """Options: path, a folder that every machine reaches (a local path or an address of a store); pattern of file names, *.jsonl; split, bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(dict(self.options))


def growing_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """A stream of columns file, at (byte where the line begins), value, reset: each whole line once.

    A line without its line feed waits for it; blank lines are passed over. Where a file is cut short or
    replaced, a row with reset and neither value nor place says that what was read of it no
    longer holds, and its lines follow from the start. Bytes that are no UTF-8 become U+FFFD. A
    file that vanishes is passed over until it is there again.
    """
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("pattern", pattern).load(root)


def current_lines(read: DataFrame, batch: str = "batch") -> DataFrame:
    """Of all lines read so far, with the number of their batch, those that still hold: columns file, at, value."""
    last = read.where("reset").groupBy(read["file"].alias("reset_file")).agg({batch: "max"}).withColumnRenamed(f"max({batch})", "since")
    held = read.where("NOT reset").join(last, read["file"] == last["reset_file"], "left")
    return held.where(f"since IS NULL OR {batch} >= since").select("file", "at", "value")
