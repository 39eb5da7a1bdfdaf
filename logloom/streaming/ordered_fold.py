"""A fold over each file's records in order, while they arrive in any order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "file string, seq bigint, cat string, turn bigint, step bigint, tokens bigint, system_seq bigint, late boolean"
STATE = "next bigint, turn bigint, step bigint, tokens bigint, system_seq bigint, held string"
#: Rows that the state of a file holds back at most; beyond it a gap counts as lost.
MOST_HELD = 10_000


class _Fold:
    """Where a file's fold stands, and the records that wait for earlier ones."""

    def __init__(self, state: GroupState):
        self.next, self.turn, self.step, self.tokens, self.system_seq, held = state.get if state.exists else (0, 0, 0, 0, None, "{}")
        self.held = {int(k): v for k, v in json.loads(held).items()}
        self.out: list[tuple] = []

    def take(self, seq: int, cat: str, tokens: int) -> None:
        if seq < self.next:
            self.out.append((seq, cat, None, None, None, None, True))
        else:
            self.held.setdefault(seq, (cat, tokens))

    def release(self, past_gaps: bool = False, down_to: int = 0) -> None:
        """Fold what is next, and past a gap where that is asked for or more than down_to wait."""
        for seq in sorted(self.held):
            if seq != self.next and not past_gaps and len(self.held) <= down_to:
                return
            cat, tokens = self.held.pop(seq)
            if cat == "user":
                self.turn, self.step = self.turn + 1, 0
            elif cat == "assistant":
                self.step += 1
            self.tokens += tokens or 0
            self.out.append((seq, cat, self.turn, self.step, self.tokens, self.system_seq, False))
            if cat == "system":
                self.system_seq = seq
            self.next = seq + 1

    def state(self) -> tuple:
        return self.next, self.turn, self.step, self.tokens, self.system_seq, json.dumps(self.held)

    def rows(self, file: str) -> pd.DataFrame:
        # Built of typed columns at once: a cast of a made frame costs many times a file's few records.
        columns = zip(*self.out, strict=True) if self.out else [()] * 7
        seq, cat, turn, step, tokens, system_seq, late = columns
        return pd.DataFrame({"file": [file] * len(seq), "seq": np.array(seq, np.int64), "cat": list(cat), **{n: _whole(c) for n, c in (("turn", turn), ("step", step), ("tokens", tokens), ("system_seq", system_seq))}, "late": np.array(late, bool)}, copy=False)


def _whole(values: tuple) -> pd.api.extensions.ExtensionArray:
    """Whole numbers and nulls as Int64."""
    gone = np.array([v is None for v in values], bool)
    return pd.arrays.IntegerArray(np.array([0 if v is None else v for v in values], np.int64), gone)


def follow_in_order(records: DataFrame, wait_ms: int | None = 60_000, forget_ms: int = 86_400_000, most_held: int = MOST_HELD) -> DataFrame:
    """Each record of a stream (file, seq, cat, tokens) with turn, step, running tokens and the system prompt before it.

    seq counts a file's records from 0; a record is folded after those before it, so the rows equal
    trajectory.turn_assignment's numbers over the whole file, in whatever batches records come. Where one is
    missing, later ones wait: for wait_ms without news of the file, or until most_held wait; then the gap
    counts as lost, and a record that comes after all is given out with `late` and no numbers. After
    forget_ms without news the state of a file goes, so the state holds live files and waiting records
    alone. wait_ms None: no timers, for a run that ends once all is read (timers keep such a run going for
    ever); what waits then stays in the state for the next run. A repeated record is late if it was folded, else one with the first. Records without file or
    seq are left out; a null count is zero.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = _Fold(state)
        if state.hasTimedOut:
            if not f.held:  # no news for so long
                state.remove()
                return
            f.release(past_gaps=True)
        for batch in batches:
            for seq, cat, tokens in zip(batch["seq"], batch["cat"], batch["tokens"], strict=True):
                f.take(int(seq), cat, 0 if pd.isna(tokens) else int(tokens))
        f.release(down_to=most_held)
        state.update(f.state())
        if wait_ms is not None:
            state.setTimeoutDuration(wait_ms if f.held else forget_ms)
        if f.out:
            yield f.rows(key[0])

    known = records.where("file IS NOT NULL AND seq IS NOT NULL").selectExpr("CAST(file AS STRING) AS file", "CAST(seq AS BIGINT) AS seq", "cat", "CAST(tokens AS BIGINT) AS tokens")
    timers = GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return known.groupBy("file").applyInPandasWithState(fold, OUT, STATE, "append", timers)
