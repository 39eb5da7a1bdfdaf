"""Operator 3, secret scans: fixed patterns, and a character convolutional network over candidates."""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import as_row, fields, map_batches, table
from logloom.sources.shared import settle

#: Fixed values of the base rules: kind, pattern, group that has a least length, least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: A run of 32 or more is the only one that counts, and none lies inside a shorter run.
_HEX = re.compile(r"[0-9a-f]{32,}")
_CUES = ("passw", "secret", "token", "apikey", "api_key")
_ORDER = {kind: k for k, (kind, *_) in enumerate(BASE)} | {"network": len(BASE)}
#: Candidates of the network: unbroken runs of key characters.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")


@dataclass(frozen=True)
class SecretNet:
    """Production parameters.

    width: characters of a view: `before` and `after` of the text around it, the others of the
    candidate. A longer candidate has several views, each over half of the one before.
    filters, kernel, embed: of the convolution. examples: labelled findings of each class that are
    made; those of the corpus are learnt from one and all. shard: views of the corpus that one copy
    of the weights is fitted to, beside the made findings, before all copies are averaged; rounds:
    of that, each of so many turns over them. recall: share of held-out secrets that the threshold
    must find; of such thresholds the most precise is taken. seed: of the examples and the weights.
    """

    width: int = 80
    before: int = 24
    after: int = 16
    embed: int = 8
    kernel: int = 5
    filters: int = 24
    examples: int = 3000
    epochs: int = 12
    shard: int = 8000
    rounds: int = 3
    turns: int = 2
    recall: float = 0.9
    seed: int = 7


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules, leftmost and without overlap within each kind."""
    out = []
    low = text.lower()
    if any(c in low for c in _CUES):
        _, pattern, group, least = BASE[0]
        out += [(m.start(), m.end(), "assign") for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    if "AKIA" in text:
        _, pattern, group, least = BASE[1]
        out += [(m.start(), m.end(), "access") for m in pattern.finditer(text) if m.end() - m.start() >= least]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs that could be secrets; the network judges all of them."""
    return [m.span() for m in _CANDIDATE.finditer(text)]


#: What parts a key from a name or a path before it, and least characters of a part.
_PART = re.compile(r"[^=/]{16,}")


def parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The run, and its parts between = and / that could be secrets alone: a key is found without its name or path."""
    inner = [(m.start(), m.end()) for m in _PART.finditer(text, start, end)]
    return [(start, end), *(p for p in inner if p != (start, end))]


def every_finding(docs: DataFrame, text: str, net: SecretNet) -> DataFrame:
    """Columns h, label, shown, first, end: the labelled findings of the corpus, each distinct one once.

    They are the keys of base spans (1) and the candidates outside of any (0), of any length, with
    the text around them; h: hash of what is shown. What is a key anywhere is one.
    """

    def of(batch: pa.RecordBatch) -> list:
        found: dict[int, tuple] = {}
        for t in batch.column(0).to_pylist():
            base = base_spans(t)
            keys = [_key(t, *s) for s in base]
            plain = [c for c in candidates(t) if not any(a < c[1] and c[0] < b for a, b, _ in base)]
            for label, spans in ((0, plain), (1, keys)):
                for a, b in spans:
                    if b - a >= 16:
                        left = t[max(0, a - net.before) : a]
                        shown = left + t[a : b + net.after]
                        own = label, shown, len(left), len(left) + b - a
                        h = xxhash.xxh64_intdigest(shown.encode("utf-8", "replace"), net.seed) >> 1
                        found[h] = max(found.get(h, own), own)
        return [list(c) for c in zip(*((h, *f) for h, f in found.items()), strict=True)] or [[], [], [], [], []]

    each = map_batches(docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), of, fields("h bigint, label bigint, shown string, first bigint, end bigint"), text=0)
    return each.groupBy("h").agg(F.max(F.struct("label", "shown", "first", "end")).alias("f")).select("h", "f.*")


def corpus_findings(docs: DataFrame, text: str, net: SecretNet) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Every finding of a small table, for fit_network; tables of any size are learnt from by fit_on_corpus."""
    rows = every_finding(docs, text, net).orderBy("h").collect()
    return [(r["shown"], r["first"], r["end"]) for r in rows], np.array([r["label"] for r in rows], np.float64)


def _key(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """The key of a base span, without the name before it."""
    if kind != "assign":
        return start, end
    return BASE[0][1].match(text, start, end).span(2)


#: Added to the numbers of characters around a candidate, which tells them from its own.
_AROUND = 128


def _views(text: str, start: int, end: int, net: SecretNet) -> list[tuple[int, int]]:
    """Parts that together cover a candidate, each with the next sharing half of it or more."""
    own = net.width - net.before - net.after
    starts = [*range(start, max(start, end - own), own // 2), max(start, end - own)]
    return [(a, min(end, a + own)) for a in starts]


def _view(text: str, start: int, end: int, net: SecretNet) -> np.ndarray:
    """Character numbers of a part of a candidate and of the text around it."""
    left = text[max(0, start - net.before) : start].rjust(net.before, "\0")
    own = text[start:end].ljust(net.width - net.before - net.after, "\0")
    right = text[end : end + net.after].ljust(net.after, "\0")
    codes = np.frombuffer((left + own + right).encode("utf-32-le", "replace"), np.uint32)
    out = np.where(codes < 128, codes, 127).astype(np.uint8)
    out[: net.before] += _AROUND
    out[net.width - net.after :] += _AROUND
    return out


def labelled_findings(net: SecretNet) -> tuple[list[tuple[str, int, int]], np.ndarray, list[int]]:
    """(text, start, end), labels 1 or 0 and where the key begins: made findings of the forms that issuers publish.

    Secrets are random keys, alone, after a cue or at the end of a path; keys of digits alone
    always have a cue. The others are what fills ordinary texts: words, joined words, identifiers,
    versions, dates, phone and account numbers, paths, addresses and rules, some beside a key.
    """
    r = random.Random(net.seed)
    syllables = "an the er on re ti es or in st ch un de la ta ri mo ne lu ka so ve di po en ung schaft keit lich ver ge be aus heit tion ment able ness con pro inter ation ing al ic ous eur oir eau que ment ción dad mente ado ir ar ble tra gen ber gra sch wort zeit hand land ou ai ie pf tz ch cht schl schm kn zw bee gei lein ster kel ner".split()
    word = lambda a=2, b=9: "".join(r.choice(syllables) for _ in range(r.randint(a, b) // 2 + 1))
    some = lambda chars, a, b: "".join(r.choices(chars, k=r.randint(a, b)))
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    secrets = (
        lambda: some(alnum, 20, 48), lambda: some(b64, 28, 60) + "=" * r.randint(0, 2), lambda: "ghp_" + some(alnum, 36, 36), lambda: "sk_live_" + some(alnum, 24, 30),
        lambda: "xoxb-" + some(string.digits, 11, 12) + "-" + some(alnum, 24, 24), lambda: "AIza" + some(alnum + "_-", 35, 35), lambda: "eyJ" + some(alnum + "_-", 30, 60), lambda: some("0123456789abcdef", 32, 64), lambda: some(string.ascii_letters, 24, 48), lambda: some(string.ascii_lowercase, 24, 48), lambda: some(string.digits, 20, 40), lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16, 16),
    )
    plain = (
        lambda: word(8, 16) + str(r.randint(1, 2030)), lambda: word(3, 6) + "-" + word(3, 8) + "-" + str(r.randint(0, 999)), lambda: word() + "_" + word() + "_" + word() + str(r.randint(0, 99)),
        lambda: f"20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}", lambda: word() + "/" + word() + "/" + word() + "/" + str(r.randint(1, 9999)), lambda: word(12, 24).upper() + str(r.randint(0, 9)),
        lambda: "/".join(word() for _ in range(4)) + str(r.randint(0, 9)), lambda: "v" + str(r.randint(0, 9)) + "-" + word(6, 12) + "-release", lambda: some(string.digits, 4, 4) + "-" + some(string.digits, 4, 4) + "-" + word(8, 10), lambda: "=" * r.randint(12, 20) + word(3, 4) + str(r.randint(0, 9)) + "=" * 4,
        lambda: word(10, 20).capitalize() + str(r.randint(0, 9)) + word(3, 6), lambda: word(14, 24), lambda: word(14, 20).capitalize(), lambda: r.choice("=-_+/") * r.randint(16, 90), lambda: some(string.digits, 16, 22),
        lambda: "/".join(word() for _ in range(r.randint(4, 14))), lambda: "-".join(word() for _ in range(r.randint(3, 12))), lambda: "com/" + word() + "/" + r.choice("TBC") + some(string.digits, 8, 8) + "/" + word() + "/" + word(),
    )
    cues = ("key = ", "credential: ", "auth ", "Authorization: Bearer ", 'access_key = "', "pwd=", "private: ", "")
    found, labels, begins = [], [], []
    for label, kinds in ((1, secrets), (0, plain)):
        for k in range(net.examples):
            run = kinds[k % len(kinds)]()
            path = ""
            if label and r.random() < 0.3:
                path = "com/" + "".join((word() if r.random() < 0.7 else some(string.ascii_uppercase, 1, 1) + some(string.digits, 8, 8)) + "/" for _ in range(r.randint(1, 8)))
            cue = r.choice(cues) if label and r.random() < 0.6 else r.choice(("", "(", "see ", "//", "no. ", "card ", "card: ", "account ", "phone: ", "id "))
            if label and run.isdigit():
                path, cue = "", r.choice(cues[:-1])
            left = " ".join(word() for _ in range(4)) + " " + cue
            right = " " + word()
            if not label and r.random() < 0.2:
                beside = r.choice(secrets)()
                left, right = (left + beside + " ", right) if r.random() < 0.5 else (left, " " + beside)
            found.append((left + path + run + right, len(left), len(left) + len(path) + len(run)))
            labels.append(label)
            begins.append(len(left) + len(path))
    return found, np.array(labels, np.float64), begins


#: Steps that a logit of one has where held-out findings are counted; logits lie within 50.
_STEPS = 1000
#: Parts of one that weights are added up in, as whole numbers, so that their order has no effect.
_PARTS = 1 << 40


class CharNet:
    """Embedding, one convolution, ReLU, greatest and mean over places, logistic output."""

    def __init__(self, net: SecretNet):
        g = np.random.default_rng(net.seed)
        self.net = net
        self.p = {
            "emb": g.normal(0, 0.3, (2 * _AROUND, net.embed)), "w": g.normal(0, (net.kernel * net.embed) ** -0.5, (net.kernel * net.embed, net.filters)),
            "b": np.zeros(net.filters), "v": g.normal(0, 0.1, 2 * net.filters), "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple:
        n, width = x.shape
        places = width - self.net.kernel + 1
        e = self.p["emb"][x]
        cols = np.concatenate([e[:, k : k + places] for k in range(self.net.kernel)], axis=2)
        h = np.maximum(cols @ self.p["w"] + self.p["b"], 0)
        top = h.argmax(1)
        f = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], axis=1)
        return cols, h, top, f, f @ self.p["v"] + self.p["c"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[k : k + 512])[4] for k in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray, turns: int | None = None) -> None:
        g, m, v, t = np.random.default_rng(self.net.seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        nf, places = self.net.filters, x.shape[1] - self.net.kernel + 1
        for _ in range(self.net.epochs if turns is None else turns):
            order = g.permutation(len(x))
            for at in range(0, len(x), 128):
                b = order[at : at + 128]
                cols, h, top, f, z = self._forward(x[b])
                d = (1 / (1 + np.exp(-z)) - y[b]) / len(b)
                df = d[:, None] * self.p["v"]
                dh = np.repeat(df[:, None, nf:] / places, places, 1)
                rows, filt = np.arange(len(b))[:, None], np.arange(nf)[None]
                dh[rows, top, filt] += df[:, :nf]
                dh *= h > 0
                dcols = dh @ self.p["w"].T
                de, size = np.zeros((*x[b].shape, self.net.embed)), self.net.embed
                for k in range(self.net.kernel):
                    de[:, k : k + places] += dcols[:, :, k * size : (k + 1) * size]
                demb = np.stack([np.bincount(x[b].ravel(), de[:, :, j].ravel(), minlength=len(self.p["emb"])) for j in range(size)], axis=1)
                grad = {"emb": demb, "w": np.tensordot(cols, dh, ([0, 1], [0, 1])), "b": dh.sum((0, 1)), "v": f.T @ d, "c": np.array([d.sum()])}
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                    self.p[k] = self.p[k] - 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on held-out findings, whose views begin at `first`, then the threshold.

        Of the thresholds that find the asked share of held-out secrets or more, the one of the
        highest precision is taken, and of equal ones the lowest; it lies in the middle between
        the last secret that it finds and what comes next below.
        """
        z = np.maximum.reduceat(self.logits(x), first)
        a, c = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * z + c)))
            a -= 0.05 * float(((p - y) * z).mean())
            c -= 0.05 * float((p - y).mean())
        self.scale, self.shift = a, c
        p = self.probability(x, first)
        order = np.argsort(-p, kind="stable")
        caught, taken = np.cumsum(y[order]), np.arange(1, len(p) + 1)
        last = np.append(np.diff(p[order]) < 0, True)  # equal probabilities are taken together
        able = np.flatnonzero(last & (caught >= self.net.recall * y.sum()))
        best = able[np.lexsort((-able, -(caught / taken)[able]))[0]]
        below = p[order][best + 1] if best + 1 < len(p) else 0.0
        self.threshold = float((p[order][best] + below) / 2)
        self.recall, self.precision = float(caught[best] / max(1, y.sum())), float(caught[best] / taken[best])

    def calibrate_counts(self, counts: np.ndarray) -> None:
        """The same from counts of held-out findings: rows of a step of the logits, how many of it are plain and how many secret.

        A step is taken whole; the threshold lies in the middle between the lower end of the last
        one taken and the upper end of the next.
        """
        counts = counts[np.argsort(-counts[:, 0])]
        low, n = counts[:, 0] / _STEPS, counts[:, 1] + counts[:, 2]
        z, share, a, c = low + 0.5 / _STEPS, counts[:, 2] / n, 1.0, 0.0
        for _ in range(200):
            wrong = 1 / (1 + np.exp(-np.clip(a * z + c, -50, 50))) - share
            a -= 0.05 * float(np.average(wrong * z, weights=n))
            c -= 0.05 * float(np.average(wrong, weights=n))
        self.scale, self.shift = max(a, 1e-3), c
        caught, taken = np.cumsum(counts[:, 2]), np.cumsum(n)
        able = np.flatnonzero(caught >= self.net.recall * caught[-1])
        best = able[np.lexsort((-able, -(caught / taken)[able]))[0]]
        next_one = low[best + 1] + 1 / _STEPS if best + 1 < len(low) else low[best] - 1
        at = self.scale * (low[best] + next_one) / 2 + self.shift
        self.threshold = float(1 / (1 + np.exp(-np.clip(at, -50, 50))))
        self.recall, self.precision = float(caught[best] / max(1, caught[-1])), float(caught[best] / taken[best])

    def steps(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The step that each finding's logit, the greatest of its views, lies in."""
        return np.floor(np.clip(np.maximum.reduceat(self.logits(x), first), -50, 50) * _STEPS).astype(np.int64)

    def packed(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.p.values()])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k, w in self.p.items():
            self.p[k] = flat[at : at + w.size].reshape(w.shape)
            at += w.size

    def probability(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each candidate, the greatest over its views; `first` are the numbers of their first ones."""
        return 1 / (1 + np.exp(-np.clip(self.scale * np.maximum.reduceat(self.logits(x), first) + self.shift, -50, 50)))


def _all_views(found: list[tuple[str, int, int]], net: SecretNet) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The views of all findings, the number of each one's first, and the parts that they show."""
    parts = [_views(*f, net) for f in found]
    first = np.cumsum([0, *map(len, parts[:-1])])
    return np.stack([_view(t, a, b, net) for (t, _, _), own in zip(found, parts, strict=True) for a, b in own]), first, [p for own in parts for p in own]


def fit_network(net: SecretNet = SecretNet(), corpus: tuple[list[tuple[str, int, int]], np.ndarray] | None = None) -> CharNet:
    """Fit on views of four fifths of the labelled findings, made and of the corpus, calibrate on the rest.

    The corpus says which runs are keys, but not that others are none. So of its candidates outside
    base spans those that a network fitted to made findings alone accepts are left out.
    A view counts as a secret where it shows 16 characters of the key; those that show fewer, but
    some, are left out of the fit.
    """
    found, y, begins = labelled_findings(net)
    if corpus is not None and len(corpus[0]):
        first = fit_network(net)
        told = (corpus[1] == 1) | (first.probability(*_all_views(corpus[0], net)[:2]) < first.threshold)
        corpus = [f for f, t in zip(corpus[0], told, strict=True) if t], corpus[1][told]
        found, y, begins = found + corpus[0], np.append(y, corpus[1]), begins + [a for _, a, _ in corpus[0]]
    held = np.arange(len(y)) % 5 == 0
    pick = lambda rows: [found[k] for k in np.flatnonzero(rows)]
    model = CharNet(net)
    model.fit(*_clear(pick(~held), y[~held], [begins[k] for k in np.flatnonzero(~held)], net))
    x, first, _ = _all_views(pick(held), net)
    model.calibrate(x, first, y[held])
    return model


def _clear(found: list[tuple[str, int, int]], y: np.ndarray, begins: list[int], net: SecretNet) -> tuple[np.ndarray, np.ndarray]:
    """The views to fit to, and whether each is of a secret: one that shows fewer than 16 characters of a key, but some, is left out."""
    x, first, parts = _all_views(found, net)
    of = np.repeat(np.arange(len(y)), np.diff([*first, len(x)]))
    shown = np.array([max(0, b - max(a, begins[k])) if y[k] else 0 for k, (a, b) in zip(of, parts, strict=True)])
    clear = (shown == 0) | (shown >= 16)
    return x[clear], (shown[clear] > 0).astype(np.float64)


def fit_on_corpus(docs: DataFrame, text: str = "text", net: SecretNet = SecretNet()) -> CharNet:
    """The network, fitted to made findings and then to every one of the corpus, four fifths of either, and calibrated on all the others.

    As in fit_network, candidates of the corpus that the network of made findings accepts are left
    out. Findings are dealt into shards by their hash; a copy of the weights is fitted to each shard beside
    the made findings, and the copies are averaged. The driver holds sums of weights and counts of steps of
    logits alone, whatever the input.
    """
    model = fit_network(net)

    def told(batch: pa.RecordBatch) -> list:
        rows = list(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True))
        keep = np.array([label == 1 for label, *_ in rows], bool)
        if not keep.all():
            keep[~keep] = model.probability(*_all_views([tuple(f) for (_, *f), k in zip(rows, keep, strict=True) if not k], net)[:2]) < model.threshold
        return [c.filter(pa.array(keep)) for c in batch.columns]

    found = every_finding(docs, text, net)
    found = settle(map_batches(found, told, found.schema, text=2))
    learns, held = found.where("h % 5 <> 0"), found.where("h % 5 = 0")
    views = learns.agg(F.sum(F.ceil((F.col("end") - F.col("first")) / 20))).first()[0]
    fitted = CharNet(net)
    fitted.unpack(model.packed())
    made, y, begins = labelled_findings(net)
    own = [k for k in range(len(y)) if k % 5]

    def fits_from(start: np.ndarray):
        def fit(group: pa.Table) -> pa.Table:
            rows = group.sort_by("h").select(["label", "shown", "first", "end"]).to_pydict()
            copy = CharNet(net)
            copy.unpack(start)
            all_found = [*(made[k] for k in own), *zip(rows["shown"], rows["first"], rows["end"], strict=True)]
            copy.fit(*_clear(all_found, np.append(y[own], np.array(rows["label"], np.float64)), [*(begins[k] for k in own), *rows["first"]], net), net.turns)
            flat = copy.packed()
            return pa.table({"place": pa.array(np.arange(len(flat))), "parts": pa.array(np.rint(flat * _PARTS).astype(np.int64))})

        return fit

    if views:
        shards = -(-int(views) // net.shard)
        for _ in range(net.rounds):
            copies = learns.groupBy(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard")).applyInArrow(fits_from(fitted.packed()), "place bigint, parts bigint")
            mean = copies.groupBy("place").agg(F.sum(F.col("parts").cast("decimal(38,0)")).alias("parts"), F.count(F.lit(1)).alias("n")).orderBy("place").collect()
            fitted.unpack(np.array([int(r["parts"]) / r["n"] / _PARTS for r in mean]))

    def step(batch: pa.RecordBatch) -> list:
        if not batch.num_rows:
            return [[], []]
        x, first, _ = _all_views(list(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)), net)
        return [pa.array(fitted.steps(x, first)), batch.column(0)]

    steps = map_batches(held.select("label", "shown", "first", "end"), step, fields("step bigint, label bigint"), text=1)
    counts = [(r["step"], r["n"] - r["secret"], r["secret"]) for r in steps.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("secret")).collect()]
    rest = [k for k in range(len(y)) if k % 5 == 0]
    x, first, _ = _all_views([made[k] for k in rest], net)
    counts += [(at, 1 - int(y[k]), int(y[k])) for at, k in zip(fitted.steps(x, first).tolist(), rest, strict=True)]
    at, of = np.unique([c[0] for c in counts], return_inverse=True)
    both = [np.bincount(of, [c[k] for c in counts]) for k in (1, 2)]
    fitted.calibrate_counts(np.stack([at.astype(np.float64), *both], axis=1))
    return fitted


def find_spans(text: str, model: CharNet) -> list[tuple[int, int, str]]:
    """All spans of a text: those of the base rules, and candidates that the network accepts.

    The network sees every candidate and its parts. Of a candidate that holds accepted parts the
    parts alone are spans. Where a span overlaps a base span, the base span alone stays.
    """
    base = base_spans(text)
    runs = [parts(text, a, b) for a, b in candidates(text)]
    if not runs:
        return base
    x, first, _ = _all_views([(text, a, b) for own in runs for a, b in own], model.net)
    p, new, at = model.probability(x, first), [], 0
    for own in runs:
        taken = [part for part, q in zip(own, p[at : at + len(own)], strict=True) if q >= model.threshold]
        new += taken[1:] if len(taken) > 1 and taken[0] == own[0] else taken
        at += len(own)
    return sorted(base + [(a, b, "network") for a, b in new if not any(a < e and s < b for s, e, _ in base)], key=lambda s: (s[0], _ORDER[s[2]]))


def _said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with every span replaced by the mark; overlapping spans are replaced as one."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text: str = "text", net: SecretNet = SecretNet(), mark: str | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns `row`, n_assign, n_access, n_hex, n_network, base_sha256, spans, and redacted if mark is given.

    Spans are kind:start:end in code points, end exclusive. The network is fitted once, by
    fit_on_corpus, and sent to the tasks (some 20 kB); docs is read twice. A null text counts as empty: no spans, and the digest of nothing; its redacted text stays null. Repeated
    rows are scanned each on its own; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_on_corpus(docs, text, net))

    def of(batch: pa.RecordBatch) -> list:
        out: list[list] = [[] for _ in range(7)]
        for t in batch.column(1).to_pylist():
            spans = find_spans(t or "", model.value)
            kinds = [k for _, _, k in spans]
            base = [s for s in spans if s[2] != "network"]
            row = [*(kinds.count(k) for k in _ORDER), hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans)]
            for k, v in enumerate([*row, None if mark is None or t is None else redacted(t, spans, mark) if spans else t]):
                out[k].append(v)
        return [batch.column(0), *(out if mark is not None else out[:6])]

    rows = as_row(docs, keep, F.col(text).cast("string").alias("text"))
    made = fields("n_assign bigint, n_access bigint, n_hex bigint, n_network bigint, base_sha256 string, spans string" + ", redacted string" * (mark is not None))
    return map_batches(rows, of, T.StructType([rows.schema["row"], *made.fields]), text=1)


def without_secrets(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", mark: str = "[secret]", **how) -> DataFrame:
    """The documents with every found secret replaced by the mark; n_chars follows where it changes."""
    found = scan(docs, text, mark=mark, **how)
    new = {text: F.col("redacted")}
    if n_chars in docs.columns:
        changed = F.col("spans") != ""
        new[n_chars] = F.when(changed, F.length("redacted").cast(docs.schema[n_chars].dataType)).otherwise(F.col(f"row.`{n_chars}`"))
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network")
