"""What the operators of this folder share: words, row handling and small helpers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run without ASCII white space; bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; the folder is the installed package's, on every executor."""
    import public_tokenizers

    return str(PurePosixPath(public_tokenizers.path(name)))


def id_share(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def as_row(df: DataFrame, keep: tuple[str, ...] | None, *extra: Column) -> DataFrame:
    """All columns, or those of keep, as one struct `row`: no name of theirs can clash with a new one."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]).alias("row"), *extra)


#: Bytes of text that a task works on at once, and whose results it holds; a longer text is worked on alone.
TEXT_BYTES = 1 << 20


def cut(batch: pa.RecordBatch, column: int, at: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `at` bytes of a string column together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // at
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Return freed memory to the system: a worker waits for its next task beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc alone
        ctypes.CDLL(None).malloc_trim(0)


#: What Spark sends a Python task at once, in bytes, where the session has not set it; Spark's own default is 64 MB, held once by the JVM and once by Python.
BATCH_CONF, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_CONF, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], list], schema: T.StructType, text: int | None = None, at: int = TEXT_BYTES, loaders: tuple[Callable, ...] = ()) -> DataFrame:
    """Apply fn to every Arrow batch; it returns the output columns in the schema's order.

    text: number of a string column by whose bytes batches are cut into slices of about `at`.
    loaders: cached functions whose results a task lets go of at its end, as workers live on into
    stages that have no use for them.
    """
    bound_batches(df.sparkSession)
    arrow = _arrow_types(schema)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole,) if text is None else cut(whole, text, at):
                columns = fn(batch)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, arrow, strict=True)], names=names)
            give_back()
        for loader in loaders:
            loader.cache_clear()
        give_back()

    return df.mapInArrow(run, schema)


def numbers(column: pa.Array, kind: type = np.uint64) -> Iterator[np.ndarray]:
    """The arrays that a binary column without nulls holds, one by one and not copied."""
    for value in column:
        yield np.frombuffer(value.as_buffer(), kind)


def _arrow_types(schema: T.StructType) -> list[pa.DataType | None]:
    """Arrow types of plain columns; a struct column is passed on as it came."""
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return [plain.get(f.dataType.simpleString()) for f in schema.fields]


def fields(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
