"""Operator 1, LM scoring: a gated recurrent language model with a class-factored softmax."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import as_row, cut, fields, id_share, map_batches, table
from logloom.sources.shared import settle


@dataclass(frozen=True)
class RecurrentLm:
    """Production parameters.

    words: of the model's vocabulary, the most frequent ones; other words belong to one of KINDS
    and share its probability in proportion to their training counts. frequent: words whose
    counts are sent to every task at most; the others meet theirs in a join. word_bytes: longest
    word of either table, which bounds their size. hidden: units. shard_texts: texts that one task
    fits its copy of the weights to before copies are averaged; shards hold all training texts.
    rounds, rate: of that, the rate falling by half each round. lanes, steps: of a training
    update; back-propagation is cut at its first step, the state is carried on. add: to every
    count.
    """

    words: int = 1000
    frequent: int = 60_000
    word_bytes: int = 64
    hidden: int = 16
    rounds: int = 3
    rate: float = 0.02
    fan: int = 64
    lanes: int = 512
    steps: int = 16
    score_lanes: int = 512
    text_bytes: int = 16 << 20
    add: float = 0.1
    seed: int = 11


#: Kinds of words outside the vocabulary: by the last byte and by whether all bytes are ASCII.
KINDS = 8


def kind_of(word: bytes) -> int:
    last = word[-1]
    end = 1 if last == 0x2E else 2 if last == 0x2C else 0 if last >= 0x80 or chr(last).isalnum() else 3
    return end + 4 * (not word.isascii())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def count_words(texts: DataFrame, held_words: int = 300_000) -> DataFrame:
    """Columns word, kind, n over all texts; each task sends a word once or a few times."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(map(kind_of, held), pa.int32()), pa.array(held.values(), pa.int64())], names=["word", "kind", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.update(words_of(t.as_py()))
                if len(held) > held_words:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return texts.mapInArrow(add, fields("word binary, kind int, n bigint")).groupBy("word", "kind").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Counts of the frequent words, and the model's tokens: the end, the kinds, the words."""

    def __init__(self, frequent: list[tuple[bytes, int, int]], n_texts: int, totals: dict[int, tuple[int, int]], how: RecurrentLm):
        """frequent: (word, kind, count) by falling count; totals[kind]: count and number of all its words."""
        self.n_all = sum(t for t, _ in totals.values()) + n_texts
        self.n_kinds = sum(d for _, d in totals.values()) + (n_texts > 0)
        self.index = {w: i for i, (w, _, _) in enumerate(frequent)}
        own = frequent[: how.words]
        self.size = 1 + KINDS + len(own)
        rest = np.array([totals.get(k, (0, 0)) for k in range(KINDS)], np.float64)
        for _, k, c in own:
            rest[k] -= c, 1
        self.base_below = np.log10(max(self.n_all + how.add * (self.n_kinds + 1), 1e-300)) if self.n_all else np.log10(how.add)
        self.kind_below = np.log10(np.maximum(rest[:, 0] + how.add * (rest[:, 1] + 1), how.add))
        counts = np.array([c for _, _, c in frequent], np.float64)
        kinds = np.array([k for _, k, _ in frequent], np.int64)
        in_model = np.arange(len(frequent)) < how.words
        # By the number of a frequent word: its token, its base score, what its kind adds, its count.
        self.token = np.where(in_model, 1 + KINDS + np.arange(len(frequent)), 1 + kinds).astype(np.int32)
        self.base = np.log10(counts + how.add) - self.base_below
        self.within = np.where(in_model, 0.0, np.log10(counts + how.add) - self.kind_below[kinds]) if len(frequent) else np.zeros(0)
        self.end_base = np.log10(n_texts + how.add) - self.base_below
        self.end_known = n_texts > 0
        self.unigram = np.concatenate([[n_texts], rest[:, 0], counts[: how.words]]) + how.add

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of a text with its end, and numbers of its frequent words (-1: another word)."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        out = np.zeros(len(words) + 1, np.int32)
        if len(words):
            if len(self.token):
                out[:-1] = self.token[at]
            rare = np.flatnonzero(at < 0)
            out[rare] = [1 + kind_of(words[i]) for i in rare.tolist()]
        return out, at


def _end_to_end(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of texts laid end to end, the token before each (0 before a text's first), and where texts begin."""
    y = np.concatenate([np.zeros(0, np.int32), *texts])
    x, begins = np.zeros_like(y), np.zeros(len(y), bool)
    x[1:] = y[:-1]
    first = np.cumsum([0, *map(len, texts)])[:-1]
    first = first[first < len(y)]
    begins[first], x[first] = True, 0
    return y, x, begins


class Gru:
    """Gated recurrent units over tokens; output by class of tokens, then by token of the class.

    Classes hold tokens of neighbouring frequency ranks. The output biases begin at the logarithms
    of the training counts, so that an unfitted model gives the counts' own probabilities.
    """

    def __init__(self, unigram: np.ndarray, how: RecurrentLm):
        self.how = how
        v, h = len(unigram), how.hidden
        g = np.random.default_rng(how.seed)
        self.per = max(1, int(np.ceil(np.sqrt(v))))
        order = np.argsort(-unigram, kind="stable")
        self.place = np.empty(v, np.int64)  # token -> place; class = place // per
        self.place[order] = np.arange(v)
        self.n_classes = -(-v // self.per)
        ranked = unigram[order]
        mass = np.array([ranked[c * self.per : (c + 1) * self.per].sum() for c in range(self.n_classes)])
        f = np.float32
        self.p = {
            "in": g.normal(0, 0.1, (v, 3 * h)).astype(f), "rec": (g.normal(0, h**-0.5, (h, 3 * h))).astype(f), "bias": np.concatenate([np.full(h, 1.0), np.zeros(2 * h)]).astype(f),
            "cls": np.zeros((h, self.n_classes), f), "cls_b": np.log(mass).astype(f), "out": np.zeros((v, h), f), "out_b": np.log(ranked).astype(f),
        }

    def step(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        return self.gates(self.p["in"].take(x, 0), state)

    def gates(self, a: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state from the input weights of the tokens; a is overwritten."""
        h = self.how.hidden
        u = state @ self.p["rec"]
        a += self.p["bias"]
        zr = a[:, : 2 * h] + u[:, : 2 * h]
        zr *= np.float32(0.5)  # a sigmoid is a tanh of half its argument
        np.tanh(zr, out=zr)
        zr *= np.float32(0.5)
        zr += np.float32(0.5)
        n = zr[:, h:] * u[:, 2 * h :]
        n += a[:, 2 * h :]
        np.tanh(n, out=n)
        new = state - n
        new *= zr[:, :h]
        new += n
        return new, zr, n, u

    def _by_class(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """An order of y by class, places within the class in it, and (class, first, end) of each that occurs."""
        place = self.place[y]
        order = np.argsort((place // self.per).astype(np.int16), kind="stable")  # sorted by radix
        sorted_ = place[order]
        edges = np.searchsorted(sorted_ // self.per, np.arange(self.n_classes + 1)).tolist()
        return order, sorted_ % self.per, [(c, edges[c], edges[c + 1]) for c in range(self.n_classes) if edges[c] < edges[c + 1]]

    def _tops(self) -> tuple[np.float32, np.ndarray]:
        """The greatest logit that any state can give to a class, and to a token of each class.

        States lie between -1 and 1, so a logit is at most its bias and the sum of its weights'
        sizes; less that, exponentials need no maximum of their own.
        """
        most = self.p["out_b"] + np.abs(self.p["out"]).sum(1)
        return (self.p["cls_b"] + np.abs(self.p["cls"]).sum(0)).max(), np.maximum.reduceat(most, np.arange(0, len(most), self.per))

    def log_probability(self, states: np.ndarray, y: np.ndarray, tops: tuple[np.float32, np.ndarray]) -> np.ndarray:
        """Natural logarithm of each token's probability after each state."""

        def log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
            own = z[np.arange(len(z)), at]
            np.exp(z, out=z)
            return own - np.log(z @ np.ones(z.shape[1], z.dtype))

        order, at, classes = self._by_class(y)
        s, out = states[order], np.empty(len(y), states.dtype)
        logits = s @ self.p["cls"]
        logits += self.p["cls_b"] - tops[0]
        got = log_share(logits, np.repeat([c for c, _, _ in classes], [b - a for _, a, b in classes]))
        for c, a, b in classes:
            own = slice(c * self.per, (c + 1) * self.per)
            z = s[a:b] @ self.p["out"][own].T
            z += self.p["out_b"][own] - tops[1][c]
            got[a:b] += log_share(z, at[a:b])
        out[order] = got
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each token sequence, from a zero state before its first token.

        Texts are dealt to lanes of about equal length; a lane carries its state from window to
        window through a whole text and clears it where the next text begins. Longer lanes come
        first, so that lanes that have ended are cut off the end. Lanes lie end to end in one
        array, so a text much longer than the others takes no room in their lanes.
        """
        n = max(1, min(self.how.score_lanes, len(texts)))
        lanes: list[list[int]] = [[] for _ in range(n)]
        load = [(0, k) for k in range(n)]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            size, k = heapq.heappop(load)
            lanes[k].append(i)
            heapq.heappush(load, (size + len(texts[i]), k))
        lanes = [lane for lane in sorted(lanes, key=lambda lane: -sum(len(texts[i]) for i in lane)) if lane]
        out = np.zeros(len(texts))
        if not lanes:
            return out
        sizes = np.array([sum(len(texts[i]) for i in lane) for lane in lanes])
        y, x, fresh = _end_to_end([texts[i] for lane in lanes for i in lane])
        owner = np.repeat(np.array([i for lane in lanes for i in lane], np.int32), [len(texts[i]) for lane in lanes for i in lane])
        first = np.cumsum(sizes) - sizes
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # lanes longer than t
        state = np.zeros((len(lanes), self.how.hidden), np.float32)
        window, tops = 32, self._tops()
        for at in range(0, int(sizes[0]), window):
            states, places = [], []
            for t in range(at, min(int(sizes[0]), at + window)):
                here = first[: live[t]] + t
                state = state[: live[t]]
                if fresh[here].any():
                    state[fresh[here]] = 0
                state = self.step(x[here], state)[0]
                states.append(state)
                places.append(here)
            here = np.concatenate(places)
            out += np.bincount(owner[here], self.log_probability(np.concatenate(states), y[here], tops), minlength=len(texts))
        return out / np.log(10)

    def fit(self, texts: list[np.ndarray], rate: float) -> int:
        """One pass of truncated back-propagation over the texts laid end to end in lanes.

        The lanes' last few tokens that fill no row are left over, fewer than there are lanes.
        """
        how, h = self.how, self.how.hidden
        flat_y, flat_x, begins = _end_to_end(texts)
        lanes = max(1, min(how.lanes, len(flat_y) // how.steps))
        width = len(flat_y) // lanes
        if not width:
            return 0
        x, y, fresh = (np.ascontiguousarray(a[: lanes * width].reshape(lanes, width).T) for a in (flat_x, flat_y, begins))
        state = np.zeros((lanes, h), np.float32)
        m, v, t_adam = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for at in range(0, width, how.steps):
            n_steps = min(how.steps, width - at)
            x_in = x[at : at + n_steps].ravel()
            a_in = self.p["in"].take(x_in, 0).reshape(n_steps, lanes, 3 * h)
            before, after = np.empty((n_steps, lanes, h), np.float32), np.empty((n_steps, lanes, h), np.float32)
            trace = []
            for t in range(n_steps):
                if fresh[at + t].any():
                    state = np.where(fresh[at + t][:, None], np.float32(0), state)
                before[t] = state
                state, zr, n, u = self.gates(a_in[t], state)
                trace.append((zr, n, u))
                after[t] = state
            grad, d_out = self._output_gradient(after.reshape(-1, h), y[at : at + n_steps].ravel())
            d_out = d_out.reshape(n_steps, lanes, h)
            carry = np.zeros((lanes, h), np.float32)
            da, du = np.empty((n_steps, lanes, 3 * h), np.float32), np.empty((n_steps, lanes, 3 * h), np.float32)
            back = np.ascontiguousarray(self.p["rec"].T)
            for t in range(n_steps - 1, -1, -1):
                zr, n, u = trace[t]
                z, r = zr[:, :h], zr[:, h:]
                d = d_out[t] + carry
                dz = d * z
                dn = d - dz
                carry = dz.copy()
                dz *= before[t] - n
                dz *= 1 - z
                dn *= 1 - n * n
                da[t, :, :h], da[t, :, 2 * h :] = dz, dn
                dn *= r
                du[t, :, :h], du[t, :, 2 * h :] = dz, dn
                dn *= u[:, 2 * h :]
                dn *= 1 - r
                da[t, :, h : 2 * h] = du[t, :, h : 2 * h] = dn
                carry += du[t] @ back
                if fresh[at + t].any():
                    carry[fresh[at + t]] = 0
            da = da.reshape(-1, 3 * h)
            grad["rec"] = before.reshape(-1, h).T @ du.reshape(-1, 3 * h)
            grad["bias"] = da.sum(0)
            t_adam += 1
            order = np.argsort(x_in, kind="stable")
            ranked = x_in[order]
            edges = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            for k, g in grad.items():
                self._adam(k, slice(None), g, m, v, t_adam, rate)
            self._adam("in", ranked[edges], np.add.reduceat(da[order], edges, axis=0), m, v, t_adam, rate)
        return lanes * width

    def _adam(self, k: str, rows, g: np.ndarray, m: dict, v: dict, t: int, rate: float) -> None:
        mk = m[k][rows] = np.float32(0.9) * m[k][rows] + np.float32(0.1) * g
        vk = v[k][rows] = np.float32(0.999) * v[k][rows] + np.float32(0.001) * g * g
        self.p[k][rows] -= np.float32(rate / (1 - 0.9**t)) * mk / (np.sqrt(vk / np.float32(1 - 0.999**t)) + np.float32(1e-6))

    def _output_gradient(self, states: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean loss: of the output weights, and of each state."""
        n, tops = np.float32(len(y)), self._tops()
        order, at, classes = self._by_class(y)
        s = states[order]
        ones = lambda e: e @ np.ones(e.shape[1], e.dtype)

        def less_own(e: np.ndarray, own: np.ndarray) -> np.ndarray:
            """From exponentials, the gradient of the logits."""
            e *= (1 / (np.maximum(ones(e), np.float32(1e-35)) * n))[:, None]
            e[np.arange(len(e)), own] -= 1 / n
            return e

        e = s @ self.p["cls"]
        e += self.p["cls_b"] - tops[0]
        e = less_own(np.exp(e, out=e), np.repeat([c for c, _, _ in classes], [b - a for _, a, b in classes]))
        grad = {"cls": s.T @ e, "cls_b": e.sum(0), "out": np.zeros_like(self.p["out"]), "out_b": np.zeros_like(self.p["out_b"])}
        d_sorted = e @ self.p["cls"].T
        for c, a, b in classes:
            own = slice(c * self.per, (c + 1) * self.per)
            e = s[a:b] @ self.p["out"][own].T
            e += self.p["out_b"][own] - tops[1][c]
            e = less_own(np.exp(e, out=e), at[a:b])
            grad["out"][own] = e.T @ s[a:b]
            grad["out_b"][own] = e.sum(0)
            d_sorted[a:b] += e @ self.p["out"][own]
        d = np.empty_like(d_sorted)
        d[order] = d_sorted
        return grad, d

    def packed(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.p.values()])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k, a in self.p.items():
            self.p[k] = flat[at : at + a.size].reshape(a.shape).astype(np.float32)
            at += a.size


def _vocabulary(counts: DataFrame, n_texts: int, how: RecurrentLm) -> Vocabulary:
    """The frequent words come to the driver: as many size classes of counts, from the top, as fit."""
    totals = {r["kind"]: (r["n"], r["words"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()}
    short = counts.where(F.octet_length("word") <= how.word_bytes)
    size = F.floor(F.log2("n") * 16).cast("int")
    classes = sorted(((r["size"], r["words"]) for r in short.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, fit = None, 0
    for s, words in classes:
        if fit + words > how.frequent:
            break
        least, fit = s, fit + words
    rows = [] if least is None else short.where(size >= least).select("word", "kind", "n").collect()
    return Vocabulary(sorted(((bytes(r["word"]), r["kind"], r["n"]) for r in rows), key=lambda r: (-r[2], r[0])), n_texts, totals, how)


def _average(copies: DataFrame, fan: int) -> list:
    """Pieces of the mean of all copies, each as heavy as the tokens it saw: a tree of means of `fan` copies at most."""

    def mean(group: pa.Table) -> pa.Table:
        group = group.sort_by("copy")
        w = group.column("tokens").to_numpy().astype(np.float64)
        made = sum(n / w.sum() * np.frombuffer(x.as_py(), np.float32) for n, x in zip(w, group.column("weights"), strict=True)).astype(np.float32)
        return pa.table({"piece": [group.column("piece")[0].as_py()], "copy": [group.column("copy")[0].as_py() // fan], "tokens": [int(w.sum())], "weights": pa.array([made.tobytes()], pa.binary())})

    last = copies.agg(F.max("copy")).first()[0]
    while last:
        copies = copies.groupBy("piece", F.expr(f"copy div {fan}")).applyInArrow(mean, copies.schema)
        last //= fan
    return sorted(copies.select("piece", "weights").collect())


def fit_model(texts: DataFrame, vocabulary: Vocabulary, how: RecurrentLm) -> Gru:
    """Fit copies of the model to partitions of the texts, average them, and go on from the mean.

    Every text is learnt from once, in the round that a hash of it names, by the task that reads
    it; so the number of copies follows the input's partitions. What comes to the driver is one
    copy of the weights a round, whatever the input.
    """
    spark = texts.sparkSession
    model = Gru(vocabulary.unigram, how)
    words = spark.sparkContext.broadcast(vocabulary)
    piece = 1 << 14
    for k in range(how.rounds):
        start = spark.sparkContext.broadcast(model.packed())
        rate = how.rate / 2**k

        def fit(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            vocab = words.value
            copy = Gru(vocab.unigram, how)
            copy.unpack(start.value)
            parts = (part for batch in batches for part in cut(batch, 0, how.text_bytes) if part.num_rows)
            seen = sum(copy.fit([vocab.tokens(words_of(t.as_py()))[0] for t in part.column(0)], rate) for part in parts)
            if seen:
                flat = copy.packed()
                pieces = [flat[a : a + piece].tobytes() for a in range(0, len(flat), piece)]
                own = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int64()), pa.array([own] * len(pieces), pa.int64()), pa.array([seen] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], names=["piece", "copy", "tokens", "weights"])

        of_round = texts.where(F.pmod(F.xxhash64(F.lit(how.seed), "text"), F.lit(how.rounds)) == k)
        mean = _average(settle(of_round.mapInArrow(fit, fields("piece bigint, copy bigint, tokens bigint, weights binary"))), how.fan)
        if mean:
            model.unpack(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in mean]))
    return model


def score_texts(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: Gru, text: str = "text", keep: tuple[str, ...] | None = None, how: RecurrentLm = RecurrentLm()) -> DataFrame:
    """Columns `row`, n_tokens, n_known, base_score, score of every text.

    Tasks score all tokens; words that are in neither table go on as rows of their own and meet
    their counts in a join, which adds their share to both scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, model))
    rows = as_row(docs, keep, F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("rid"))
    schema = T.StructType([*fields("rid bigint, word binary, kind int, n bigint").fields, T.StructField("row", rows.schema["row"].dataType), *fields("n_tokens bigint, n_known bigint, base double, score double").fields])

    def of(batch: pa.RecordBatch) -> list:
        vocab, gru = sent.value
        rids, texts = batch.column(2).to_pylist(), batch.column(1)
        head, source, more = [], [], [[], [], [], []]
        tokens, base, known, within = [], [], [], []
        for i, rid in enumerate(rids):
            words = words_of(texts[i].as_py())
            t, at = vocab.tokens(words)
            own = at[at >= 0]
            tokens.append(t)
            base.append(vocab.base[own].sum() + vocab.end_base)
            within.append(vocab.within[own].sum())
            known.append(len(own) + int(vocab.end_known))
            for w, n in Counter(words[k] for k in np.flatnonzero(at < 0).tolist()).items():
                for o, v in zip(more, (rid, w, kind_of(w), n), strict=True):
                    o.append(v)
            head.append(b" %d" % rid)  # no word holds a blank, so a text's own row meets no count
        score = gru.score(tokens)
        n, m = len(rids), len(more[0])
        own_rows = batch.column(0)
        picked = pa.concat_arrays([own_rows, pa.nulls(m, own_rows.type)]) if m else own_rows
        pad = lambda a: [*a, *[0] * m]
        return [rids + more[0], head + more[1], [0] * n + more[2], [0] * n + more[3], picked, pad(map(len, tokens)), pad(known), pad(map(float, base)), pad((score + np.array(within)).tolist())]

    scored = map_batches(rows, of, schema, text=1, at=how.text_bytes)
    below, base_below = F.array(*[F.lit(float(k)) for k in vocabulary.kind_below]), float(vocabulary.base_below)
    c = F.coalesce(F.col("c"), F.lit(0))
    log_count = F.log10(c + how.add)
    met = scored.join(counts.select("word", F.col("n").alias("c")), "word", "left").select(
        "rid", "row", "n_tokens", (F.col("n_known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.col("n") * (log_count - base_below)).alias("base"), (F.col("score") + F.col("n") * (log_count - F.element_at(below, F.col("kind") + 1))).alias("score"),
    )
    return met.groupBy("rid").agg(F.first("row", True).alias("row"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score")).drop("rid")


def language_model_scores(docs: DataFrame, learns, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] | None = None, how: RecurrentLm = RecurrentLm()) -> DataFrame:
    """Learn from the rows where the condition holds, score all rows.

    Columns `row`, n_tokens, n_known, train_tokens, base_score, score. Tokens are words, then one
    end for each text; a null text is empty and has its end alone. base_score is the texts'
    log10 probability by single counts, score that of the recurrent model. Both share among all
    unseen words what one of them would get. Repeated rows are learnt from and scored each on its
    own. If nothing is learnt from, train_tokens is 0 and the base gives every token
    probability one. An empty table gives an empty result.
    """
    training = docs.where(learns).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(doc_id).alias("id"))
    counts = settle(count_words(training.select("text")))
    n_texts = training.count()
    vocabulary = _vocabulary(counts, n_texts, how)
    model = fit_model(training.select("text"), vocabulary, how)
    return score_texts(docs, counts, vocabulary, model, text, keep, how).withColumn("train_tokens", F.lit(int(vocabulary.n_all)).cast("bigint"))


def op1_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = language_model_scores(docs, id_share("doc_id", 10) != 0, keep=("doc_id",))
    return scored.select("row.doc_id", (id_share("row.doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
