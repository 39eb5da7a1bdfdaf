"""Operator 11, periodic runs of words: bit planes of word ids compared with themselves at every lag."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import as_row, fields, map_batches, table

#: Least number of words in a run; a run also holds its period twice at least.
LEAST = 12


def zero_stretches(mismatch: int, size: int, least: int) -> list[tuple[int, int]]:
    """[from, to) of the maximal stretches of at least `least` zero bits among the lowest `size` bits."""
    long = ~mismatch & ((1 << size) - 1)
    have = 1
    while have < least and long:  # bit i: the `have` bits from i on are all zero
        step = min(have, least - have)
        long &= long >> step
        have += step
    if not long:
        return []
    bits = np.unpackbits(np.frombuffer(long.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(bits, prepend=0, append=0)).tolist()
    return [(a, b - 1 + least) for a, b in zip(edges[::2], edges[1::2], strict=True)]


class Lags:
    """Which lags can hold a run: those at which some sampled window of words comes again.

    A run of period q leaves at least max(LEAST - q, q) neighbouring places whose words come again q later.
    So of windows of w words sampled every s places, w + s - 1 not above that, one lies among them. Windows are told
    apart by ranks, doubled from words on. Of a known run of a period that divides q the samples are expected,
    so only a greater count than that asks for a look at lag q. The counts of all lags between two powers of two
    take two comparisons a word.
    """

    #: Comparisons made at once.
    BLOCK = 1 << 20

    def __init__(self, ids: np.ndarray):
        self.ranks = {1: ids}

    def rank(self, w: int) -> np.ndarray:
        """Equal numbers where the same w words follow; w is a power of two."""
        if w not in self.ranks:
            half = self.rank(w // 2)
            pair = half[: -(w // 2)].astype(np.int64) * (int(half.max()) + 1) + half[w // 2 :]
            self.ranks = {1: self.ranks[1], w: np.unique(pair, return_inverse=True)[1]}
        return self.ranks[w]

    @staticmethod
    def windows(low: int) -> tuple[int, int]:
        """Words and distance of the windows for lags from low up to twice that."""
        return (4, 4) if low < 4 else (4, 2) if low < 8 else (low // 2, low // 2)

    def counts(self, low: int) -> np.ndarray:
        """For the lags from low up to twice that: the sampled places whose windows come again."""
        w, step = self.windows(low)
        n = len(self.ranks[1])
        lags = np.arange(low, min(2 * low, n // 2 + 1))
        if not len(lags) or n < w + low:
            return np.zeros(len(lags), np.int64)
        rank = self.rank(w)
        if int(rank.max()) + 1 == len(rank):
            return np.zeros(len(lags), np.int64)  # no window comes twice
        at = np.arange(0, len(rank), step)
        out = []
        padded = np.concatenate([rank, np.full(2 * low, -1, rank.dtype)])
        for part in np.array_split(lags, max(1, len(lags) * len(at) // self.BLOCK + 1)):
            near = np.lib.stride_tricks.sliding_window_view(padded, len(part))[at + part[0]] if len(part) else np.empty((0, 0))
            out.append((near == rank[at][:, None]).sum(0))
        return np.concatenate(out)

    @classmethod
    def expected(cls, low: int, lag: int, run: tuple[int, int]) -> int:
        """Samples at which a run [from, to) of a divisor of the lag shows at the lag."""
        w, step = cls.windows(low)
        first, last = -(-run[0] // step), (run[1] - lag - w) // step
        return max(0, last - first + 1)


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    ids: numbers of the words. A run is a stretch of words with smallest period q and a length of
    at least max(12, 2 q) that cannot be extended with period q.
    """
    n = len(ids)
    if n < LEAST:
        return []
    ids = ids.astype(np.int64)
    lags = Lags(ids)
    planes: list[int] = []
    found: dict[tuple[int, int], int] = {}
    known: dict[int, list[tuple[int, int]]] = defaultdict(list)
    low = 1
    while low <= n // 2:
        counts = lags.counts(low)
        for lag in (np.flatnonzero(counts) + low).tolist():
            # Runs of divisors found among the lags before count as well, so they are looked up lag by lag.
            if counts[lag - low] <= sum(Lags.expected(low, lag, r) for r in known.get(lag, ())):
                continue
            if not planes:
                planes = [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(max(1, int(ids.max()).bit_length()))]
            mismatch = 0
            for plane in planes:
                mismatch |= plane ^ plane >> lag
            for a, b in zero_stretches(mismatch, n - lag, max(LEAST - lag, lag)):
                if (a, b + lag) not in found:  # else its smallest period is a smaller one, that divides this lag
                    found[a, b + lag] = lag
                    for multiple in range(2 * lag, (b + lag - a) // 2 + 1, lag):
                        known[multiple].append((a, b + lag))
        for lag in range(low, 2 * low):
            known.pop(lag, None)
        low *= 2
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first q words, joined by one blank."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, text: str = "text", prepare: Callable[[object, int], np.ndarray | None] | None = None, key: str = "doc_id", keep: tuple[str, ...] | None = None, with_text: bool = True) -> DataFrame:
    """Columns `row`, n_words, runs (array of struct start, length, period), collapsed (if with_text), runs_sha256, collapsed_sha256.

    prepare(key, number of words): which word to put at each place before the search, or None for the text as it is.
    Words are stretches without ASCII white space; a null text has none. Whole texts of any length
    are searched. Of a run's words those after its first period are left out of `collapsed`, whose
    words are joined by one blank; without a run it is the text's words so joined. Repeated rows are
    searched each on its own; an empty table gives an empty result; columns of any name are kept
    within `row`; a null key is handed to prepare as None.
    """

    def of(batch: pa.RecordBatch) -> list:
        n, starts, lengths, periods, per, said, digest_r, digest_c = [], [], [], [], [0], [], [], []
        for k, t in zip(batch.column(1), batch.column(2).cast(pa.binary()), strict=True):
            words = (t.as_py() or b"").split()
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
            if words and prepare and (places := prepare(k.as_py(), len(words))) is not None:
                ids, words = ids[places], [words[p] for p in places.tolist()]
            runs = runs_of(ids)
            short = collapsed(words, runs)
            n.append(len(words))
            for out, of_run in ((starts, 0), (lengths, 1), (periods, 2)):
                out.extend(r[of_run] for r in runs)
            per.append(len(starts))
            said.append(short.decode() if with_text else None)
            digest_r.append(hashlib.sha256("".join(f"{a},{b},{q}\n" for a, b, q in runs).encode()).hexdigest())
            digest_c.append(hashlib.sha256(short).hexdigest())
        structs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], ["start", "length", "period"])
        return [batch.column(0), n, pa.ListArray.from_arrays(pa.array(per, pa.int32()), structs), *([said] if with_text else []), digest_r, digest_c]

    rows = as_row(docs, keep, F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    made = fields("n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>" + ", collapsed string" * with_text + ", runs_sha256 string, collapsed_sha256 string")
    return map_batches(rows, of, T.StructType([rows.schema["row"], *made.fields]), text=2)


def planted(key: str | None, n: int) -> np.ndarray | None:
    """The periodic words of the contract: one text in ten, by crc32 of its id (null: of nothing), repeats from a place on."""
    h = zlib.crc32((key or "").encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = periodic_runs(table(spark, sf_dir, "documents"), prepare=planted, keep=("doc_id",), with_text=False)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    length = (-F.col("best.n")).alias("length")
    return made.select("row.doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("best"), "runs_sha256", "collapsed_sha256").select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length, F.col("best.period").alias("period"),
        F.expr("(-1000 * best.n) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
