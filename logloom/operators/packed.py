"""Streams packed into runs: fragments with the time between each two, as single chunks again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What runs are called, and the chunks they stand for; a run of another name stands for reasoning.
KINDS = {"text-chunks": "text-delta", "tool-call-chunks": "tool-call-delta"}
OTHER = "reasoning-delta"

_MADE = "seq bigint, t_ms bigint, text string, first boolean"


def expand_runs(runs: DataFrame) -> DataFrame:
    """Columns file, seq, t_ms, kind, index, text, call_id, name, turn, step: a row for each fragment of each run.

    runs: file, type, seq0, time0, index, turn, step, call_id, name, texts (array of strings) and dt
    (array of longs). The k-th fragment has seq0 + k and time0 plus the first k gaps, summed inside the run's row,
    so nothing is moved. Fragments end where a gap is missing. A run without time0 or texts gives none; a missing
    seq0 or index is zero; a null fragment is the empty text. name is that of a tool's first chunk alone.
    """
    kept = F.struct("file", "type", "index", "turn", "step", "call_id", "name").alias("run")
    rows = runs.where(F.col("time0").isNotNull() & (F.size("texts") > 0)).select(kept, F.coalesce("seq0", F.lit(0)).cast("bigint").alias("seq0"), F.col("time0").cast("bigint").alias("time0"), F.col("texts").cast("array<string>").alias("texts"), F.coalesce(F.col("dt").cast("array<bigint>"), F.array().cast("array<bigint>")).alias("dt"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, seqs, times, texts, first = [], [], [], [], []
            for row, (seq0, time0) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                said, gaps = batch.column(3)[row].values, batch.column(4)[row].values
                missing = np.flatnonzero(gaps.is_null().to_numpy(zero_copy_only=False))
                n = min(len(said), 1 + (int(missing[0]) if len(missing) else len(gaps)))
                taken.append(np.full(n, row))
                seqs.append(seq0 + np.arange(n))
                times.append(time0 + np.concatenate([[0], np.cumsum(gaps.slice(0, n - 1).to_numpy(zero_copy_only=False).astype(np.int64))]))
                texts.append(said.slice(0, n).fill_null(""))
                first.append(np.arange(n) == 0)
            if taken:
                whole = [batch.column(0).take(pa.array(np.concatenate(taken))), *map(pa.array, (np.concatenate(seqs), np.concatenate(times))), pa.concat_arrays(texts), pa.array(np.concatenate(first))]
                yield pa.RecordBatch.from_arrays(whole, names=["run", "seq", "t_ms", "text", "first"])

    made = rows.mapInArrow(expand, T.StructType([rows.schema["run"], *T.StructType.fromDDL(_MADE).fields]))
    kind = F.lit(OTHER)
    for run, chunk in KINDS.items():
        kind = F.when(F.col("run.type") == run, chunk).otherwise(kind)
    tool = F.col("run.type") == "tool-call-chunks"
    return made.select(
        "run.file", "seq", "t_ms", kind.alias("kind"), F.coalesce("run.index", F.lit(0)).cast("bigint").alias("index"), "text", F.when(tool, F.coalesce("run.call_id", F.lit(""))).alias("call_id"),
        F.when(tool & F.col("first"), F.col("run.name")).alias("name"), "run.turn", "run.step",
    )
