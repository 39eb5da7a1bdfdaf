"""Operator 5, language ID: prediction by partial matching over byte context trees."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.common import as_row, fields, id_share, map_batches, table
from logloom.sources.shared import settle

UNKNOWN = "und"


@dataclass(frozen=True)
class Ppm:
    """Production parameters.

    depth: bytes of the longest context. contexts: of each length, a language has nodes for at
    most so many of its own, its most frequent ones; after another context its code is that of
    the shorter one. They bound a tree's size, not the counts, which cover all texts.
    block_langs: languages whose trees are one table; a text meets one table after another, so
    their number is not bounded. A table has at most contexts * block_langs nodes a length.
    """

    depth: int = 3
    contexts: int = 8_000
    block_langs: int = 4


#: Bytes of a text that are worked on at once, and nodes whose probabilities are.
PIECE = 500_000
_NODES = 1024


def _pieces(raw: bytes, depth: int) -> Iterator[bytes]:
    """A text cut into pieces, each with the `depth` bytes before it; zeros precede the text."""
    for at in range(0, len(raw), PIECE):
        yield (bytes(depth) + raw[:PIECE]) if at == 0 else raw[at - depth : at + PIECE]


def _grams(piece: bytes, depth: int) -> np.ndarray:
    """Each byte of a piece with the `depth` bytes before it, as one number."""
    b = np.frombuffer(piece, np.uint8).astype(np.uint32)
    n = len(b) - depth
    code = np.zeros(n, np.uint32)
    for k in range(depth + 1):
        code = (code << np.uint32(8)) | b[k : k + n]
    return code


def _grouped(pieces: Iterable, length: Callable = len) -> Iterator[list]:
    """Lists of pieces of a few PIECE bytes together at most."""
    group, size = [], 0
    for p in pieces:
        group.append(p)
        size += length(p)
        if size > PIECE:
            yield group
            group, size = [], 0
    if group:
        yield group


def count_grams(docs: DataFrame, text: str, lang: str, how: Ppm) -> DataFrame:
    """Columns lang, gram, n: how often each run of depth + 1 bytes occurs in each language's texts.

    Every task adds up its own texts and sends each run once or a few times.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            langs, grams, counts = [], [], []
            for name, parts in held.items():
                code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                langs += [name] * len(code)
                grams.append(code.astype(np.int64))
                counts.append(n)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(grams)), pa.array(np.concatenate(counts))], names=["lang", "gram", "n"])

        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(t.encode("utf-8", "replace"))
            for name, raws in by.items():
                for group in _grouped(piece for raw in raws for piece in _pieces(raw, how.depth)):
                    code, n = np.unique(np.concatenate([_grams(p, how.depth) for p in group]), return_counts=True)
                    held.setdefault(name, []).append((code, n))
                    size += len(code)
            if size > 4_000_000:
                yield flush()
                held, size = {}, 0
        if size:
            yield flush()

    known = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    counted = known.mapInArrow(add, fields("lang string, gram bigint, n bigint"))
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _probabilities(n: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """From counts of symbols (node, symbol, language) and the probabilities after the shorter contexts."""
    total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
    unseen = np.where(n > 0, 0.0, prior)
    rest = unseen.sum(1, keepdims=True)
    # Where every symbol has been seen nothing is left to escape to, and the counts are all.
    open_ = rest > 1e-12
    bottom = np.maximum(np.where(open_, total + kinds, total), 1)
    return np.where(total > 0, n / bottom + np.where(open_, kinds / bottom * unseen / np.where(open_, rest, 1), 0.0), prior)


class ContextTrees:
    """Trees of byte contexts of some languages, frozen into tables of code lengths.

    Node k of a length stands for the same context in every language. Where a language has seen
    a byte after a context n times of N, with d bytes seen, its probability is n / (N + d); the
    escape d / (N + d) is shared among the unseen ones in proportion to their probability after
    the context that is one byte shorter. So the probabilities after each context sum to one,
    and the sum of code lengths is the exact length of the text's code. Bytes that no language
    of the table has seen are equally likely after every context, and share one symbol.
    """

    def __init__(self, langs: list[str], counts: list[dict[str, np.ndarray]], how: Ppm):
        """counts[k]: rows (lang number, gram of k + 1 bytes, n) of contexts of k bytes, k = 0 … depth."""
        self.langs, self.how = langs, how
        n_langs = len(langs)
        own = np.unique(np.append(counts[0]["gram"].astype(np.int64), 0))  # zero stands before a text
        self.symbol = np.full(256, len(own), np.int64)  # the last symbol: any other byte
        self.symbol[own] = np.arange(len(own))
        n_sym = len(own) + 1
        share = np.log2(max(1, 256 - len(own)))
        prior = np.full((1, n_sym, n_langs), 1.0 / 256, np.float32)
        prior[:, -1] *= 256 - len(own)
        self.find: list[np.ndarray] = []
        tables, parents = [], np.zeros(1, np.int64)
        numbers = np.zeros(1, np.int64)  # contexts that have a node, as symbol strings in base n_sym
        offset, self.base = 0, []
        for k, c in enumerate(counts):
            gram, lang, weight = c["gram"].astype(np.int64), c["lang"].astype(np.int64), c["n"].astype(np.float64)
            syms = [self.symbol[(gram >> (8 * (k - i))) & 255] for i in range(k + 1)]
            context = np.zeros(len(gram), np.int64)
            for s in syms[:-1]:
                context = context * n_sym + s
            if k:
                # A context has a node only if the one shorter by its first byte has one.
                shorter = context % n_sym ** (k - 1)
                at = np.searchsorted(numbers, shorter)
                known = (numbers[np.minimum(at, len(numbers) - 1)] == shorter) if len(numbers) else np.zeros(len(gram), bool)
                context, lang, weight, last = context[known], lang[known], weight[known], syms[-1][known]
                fresh = np.unique(context)
                parents = np.searchsorted(numbers, fresh % n_sym ** (k - 1))
                # From node of the shorter context and the byte before it to the node.
                step = np.full((len(numbers), n_sym), -1, np.int32)
                step[parents, fresh // n_sym ** (k - 1)] = np.arange(len(fresh))
                self.find.append(step)
                numbers = fresh
            else:
                last = syms[-1]
            order = np.argsort(context, kind="stable")
            node, last, lang, weight = np.searchsorted(numbers, context[order]), last[order], lang[order], weight[order]
            made = np.empty((len(numbers), n_sym, n_langs), np.float32)
            for first in range(0, len(numbers), _NODES):
                a, b = np.searchsorted(node, [first, first + _NODES])
                n = np.zeros((min(_NODES, len(numbers) - first), n_sym, n_langs))
                np.add.at(n, (node[a:b] - first, last[a:b], lang[a:b]), weight[a:b])
                made[first : first + _NODES] = _probabilities(n, prior[parents[first : first + _NODES]])
            prior = made
            bits = -np.log2(np.maximum(made, 1e-37))
            bits[:, -1] += share
            tables.append(bits)
            self.base.append(offset)
            offset += len(bits)
        self.bits = np.concatenate(tables).reshape(-1, n_langs)
        self.n_sym = n_sym

    def code_lengths(self, raws: list[bytes]) -> np.ndarray:
        """Bits of each text in each language's code."""
        out = np.zeros((len(raws), len(self.langs)))
        for group in _grouped(((i, p) for i, raw in enumerate(raws) for p in _pieces(raw, self.how.depth)), lambda x: len(x[1])):
            self._add(group, out)
        return out

    def _add(self, group: list[tuple[int, bytes]], out: np.ndarray) -> None:
        depth = self.how.depth
        joined = np.frombuffer(b"".join(p for _, p in group), np.uint8)
        sym = self.symbol[joined]
        node = np.zeros(len(sym), np.int64)  # the node of the longest context found so far
        deep = np.zeros(len(sym), np.int64)
        live = np.ones(len(sym), bool)
        for k, step in enumerate(self.find, 1):
            before = np.zeros(len(sym), np.int64)
            before[k:] = sym[:-k]
            nxt = step[np.where(live, node, 0), before] if len(step) else np.full(len(sym), -1)
            live &= nxt >= 0
            node = np.where(live, nxt, node)
            deep += live
        rows = (np.asarray(self.base)[deep] + node) * self.n_sym + sym
        ends = np.cumsum([len(p) for _, p in group])
        starts = np.concatenate([[0], ends[:-1]]) + depth
        owner = [i for i, _ in group]
        for lang in range(len(self.langs)):
            total = np.concatenate([[0.0], np.cumsum(self.bits[:, lang][rows], dtype=np.float64)])
            np.add.at(out[:, lang], owner, total[ends] - total[starts])


def fit_trees(docs: DataFrame, text: str = "text", lang: str = "lang", how: Ppm = Ppm()) -> list[bytes]:
    """Pickled ContextTrees of all languages that have a row with a text, block_langs in each; none without such rows.

    Contexts are chosen and tables built on the executors, each from the rows of its own
    languages' nodes; only finished tables come to the driver, to be sent to the tasks.
    """
    grams = settle(count_grams(docs, text, lang, how))
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())  # names alone
    blocks = [langs[k : k + how.block_langs] for k in range(0, len(langs), how.block_langs)]
    place = F.create_map(*[x for b, own in enumerate(blocks) for k, name in enumerate(own) for x in (F.lit(name), F.struct(F.lit(b).alias("block"), F.lit(k).alias("lang")))]) if langs else None
    if place is None:
        return []
    rows = []
    for k in range(how.depth + 1):
        short = grams.groupBy("lang", (F.col("gram") % (1 << 8 * (k + 1))).alias("gram")).agg(F.sum("n").alias("n"))
        if k > 1:
            by_weight = Window.partitionBy("lang").orderBy(F.desc("weight"), "context")
            top = short.groupBy("lang", F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("weight")).withColumn("place", F.row_number().over(by_weight)).where(F.col("place") <= how.contexts)
            short = short.withColumn("context", F.shiftright("gram", 8)).join(settle(top.select("lang", "context")), ["lang", "context"], "left_semi")
        rows.append(short.select(place[F.col("lang")].alias("at"), F.lit(k).alias("size"), "gram", "n").select("at.block", "at.lang", "size", "gram", "n"))

    def build(group: pa.Table) -> pa.Table:
        columns = {c: group.column(c).to_numpy() for c in ("lang", "size", "gram", "n")}
        block = group.column("block")[0].as_py()
        parts = [{c: columns[c][columns["size"] == k] for c in ("lang", "gram", "n")} for k in range(how.depth + 1)]
        packed = pickle.dumps(ContextTrees(blocks[block], parts, how), protocol=5)
        cuts = [packed[a : a + _SENT] for a in range(0, len(packed), _SENT)]
        return pa.table({"block": pa.array([block] * len(cuts), pa.int32()), "part": pa.array(range(len(cuts)), pa.int32()), "bytes": pa.array(cuts, pa.binary())})

    made = settle(reduce(DataFrame.unionByName, rows).groupBy("block").applyInArrow(build, fields("block int, part int, bytes binary")))
    out: list[list[bytes]] = [[] for _ in blocks]
    for r in made.orderBy("block", "part").collect():
        out[r["block"]].append(bytes(r["bytes"]))
    return [b"".join(x) for x in out]


#: Bytes of a table in one row.
_SENT = 8 << 20


@lru_cache(maxsize=2)
def _trees(packed: bytes) -> ContextTrees:
    return pickle.loads(packed)


def predict(docs: DataFrame, trees: list[bytes], text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns `row`, lang_pred, score and bits_per_byte of the whole text in the predicted code.

    score is the posterior probability of the language among the learned ones, each as likely
    beforehand. Texts that are null or without a letter, and all texts if nothing was learned,
    are `und` with score 0. Equal code lengths: the language that sorts first. Each table is met
    in a step of its own, which carries on the best code so far and the sum of likelihoods.
    """
    rows = as_row(docs, keep, F.col(text).cast("string").alias("text"))
    met = rows.withColumns({"who": F.lit(None).cast("string"), "best": F.lit(None).cast("double"), "mass": F.lit(0.0)})
    for packed in trees:
        sent = docs.sparkSession.sparkContext.broadcast(packed)

        def of(batch: pa.RecordBatch, sent=sent) -> list:
            model = _trees(sent.value)
            bits = model.code_lengths([(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()])
            old = np.array([np.inf if x is None else x for x in batch.column(3).to_pylist()])
            here = bits.min(1)
            best = np.minimum(here, old)
            mass = np.array(batch.column(4).to_pylist()) * np.exp2(np.where(np.isfinite(old), best - old, 0)) + np.exp2(best[:, None] - bits).sum(1)
            who = [model.langs[k] if new else name for k, new, name in zip(bits.argmin(1), here < old, batch.column(2).to_pylist(), strict=True)]
            return [batch.column(0), batch.column(1), who, best.tolist(), mass.tolist()]

        met = map_batches(met, of, met.schema, text=1)
    spoken = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.col("who").isNotNull()
    size = F.octet_length("text")
    return met.select("row", F.when(spoken, F.col("who")).otherwise(UNKNOWN).alias("lang_pred"), F.when(spoken, 1 / F.col("mass")).otherwise(0.0).alias("score"), F.when(size > 0, F.col("best") / size).alias("bits_per_byte"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_share("doc_id", 4) == 2
    found = predict(docs, fit_trees(docs.where(~held_out)), keep=("doc_id",))
    return found.select("row.doc_id", (id_share("row.doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")
