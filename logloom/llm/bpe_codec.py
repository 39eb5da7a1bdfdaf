"""Operator 4, BPE encoding and decoding: a backtracking encoder over Aho-Corasick matches."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import as_row, fields, give_back, map_batches, table, tokenizer_path

#: The last unit of a word is another symbol than the same unit inside one; it lies this much higher.
_LAST = 0x1000
_WORD_END = "</w>"
#: Distinct words whose encodings a worker keeps; later ones are encoded each time.
MEMO_WORDS = 100_000
#: Rows of the pair-compatibility table that a worker keeps.
MEMO_PAIRS = 100_000


def _byte_units() -> dict[int, str]:
    """The printable stand-ins for bytes that byte-level vocabularies are written in."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class BacktrackingBpe:
    """Encode as greedy merging by rank would, from longest matches and a compatibility table.

    A sequence of tokens is what merging yields if and only if every two neighbours are what
    merging yields for their joint text. So the encoder takes the longest token at each place,
    steps to shorter ones while a neighbour does not fit, and goes back when none fits; no place
    is entered twice after it has failed. Tokens are numbered by rank: single units first,
    then merges in their order.
    """

    def __init__(self, units: list[str], merges: list[tuple[str, str]]):
        self.text = list(units)
        number = {u: k for k, u in enumerate(units)}
        self.parts: list[tuple[int, int] | None] = [None] * len(units)
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = number[left], number[right]
            token = number.setdefault(left + right, len(self.text))
            if token == len(self.text):
                self.text.append(left + right)
                self.parts.append(pair)
            self.merged.setdefault(pair, token)
        self.number = number
        self.length = [len(t) for t in self.text]
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in self.text]
        self.matcher = ahocorasick.Automaton()
        for t, k in number.items():
            self.matcher.add_word(t, k)
        self.matcher.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when their joint text is merged by rank."""
        known = self._compatible(a, b)
        if len(self.fits) < MEMO_PAIRS:
            self.fits[a, b] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the later of the two last merges again and again; at each border between what is
        # left, a merge that ranks before the one undone last would have joined the two sides.
        before = len(self.text)
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < before:
                return False
            if a > b:
                before, split = a, self.parts[a]
                if split is None:
                    before, split = b + 1, self.parts[b]
                    if split is None:
                        return True
                    b = split[0]
                else:
                    a = split[1]
            else:
                before, split = b + 1, self.parts[b]
                if split is None:
                    before, split = a, self.parts[a]
                    if split is None:
                        return True
                    a = split[1]
                else:
                    b = split[0]

    def encode(self, word: str) -> list[int]:
        if not word:
            return []
        longest = [-1] * len(word)
        length, fits = self.length, self.fits
        for end, token in self.matcher.iter(word):  # ends ascend, so a longer match replaces a shorter one
            longest[end + 1 - length[token]] = token
        open_, out, at, token = [True] * (len(word) + 1), [], 0, longest[0]
        while at < len(word):
            end = at + length[token]
            if open_[end] and (not out or (fits[pair] if (pair := (out[-1], token)) in fits else self.compatible(*pair))):
                out.append(token)
                at = end
                if at < len(word):
                    token = longest[at]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_[at] = False
                token = out.pop()
                at -= length[token]
        return out


class WordBpeCodec:
    """The whole tokeniser of a word-BPE file: special tokens, normalisation, words, ids, text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # \s of the file means Unicode's White_Space; the class is spelled out, as engines differ.
        self.words = regex.compile(split.replace(r"[^\s", r"[^\t-\r \x85\xa0  -     　"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.units = _byte_units()

        def symbols(token: str) -> str:
            if token.endswith(end) and len(token) > len(end):
                token = token[: -len(end)]
                return token[:-1] + chr(ord(token[-1]) + _LAST)
            return token

        single = sorted((t for t in vocab if len(symbols(t)) == 1), key=vocab.get)
        self.bpe = BacktrackingBpe([symbols(t) for t in single], [(symbols(a), symbols(b)) for a, b in merges])
        by_symbols = {symbols(t): i for t, i in vocab.items()}
        self.ids = [by_symbols[t] for t in self.bpe.text]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.decimal = [str(i) for i in range(max(chain(vocab.values(), self.special.values()), default=-1) + 1)]
        # Decoding: the texts of all ids behind one another, each with the blank that parts
        # tokens, and where each begins.
        texts = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pieces = [(texts.get(i, "") + " ").encode() for i in range(max(texts) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def _word(self, word: str) -> tuple[int, ...]:
        units = word.encode("utf-8", "replace").decode("latin-1").translate(self.units)
        made = tuple(self.ids[t] for t in self.bpe.encode(units[:-1] + chr(ord(units[-1]) + _LAST)))
        if len(self.memo) < MEMO_WORDS and len(word) <= 64:
            self.memo[word] = made
        return made

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character's own lower case (a capital sigma never becomes a final one)."""
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "σ".join(map(str.lower, text.split("Σ")))

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids of the text, and the same in decimal with blanks between."""
        ids: list[int] = []
        memo = self.memo
        for piece in self.special_at.split(text) if "<|" in text else (text,):
            if piece in self.special:
                ids.append(self.special[piece])
                continue
            ids += chain.from_iterable([memo.get(word) or self._word(word) for word in self.words.findall(self.normal(piece))])
        return ids, " ".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        """The texts of the ids with blanks between, as UTF-8, by gathering from the offset table."""
        if not ids:
            return b""
        a = np.asarray(ids, np.int64)
        start, size = self.offsets[a], self.offsets[a + 1] - self.offsets[a]
        first = np.cumsum(size) - size
        return self.bytes[np.arange(int(size.sum())) + np.repeat(start - first, size)].tobytes()[:-1]


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpeCodec:
    made = WordBpeCodec(path)
    give_back()  # what the file took while it was read
    return made


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, with_ids: bool = True, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns `row`, n_tokens, ids (array, if with_ids), ids_sha256, decoded_sha256.

    A null text is encoded as the empty text: no tokens, and digests of nothing. Whole texts of
    any length are encoded; one word of any length takes time in proportion. Repeated rows are
    encoded each on its own; an empty table gives an empty result.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    def of(batch: pa.RecordBatch) -> list:
        c = codec(path)
        n, every, a, b = [], [], [], []
        for t in batch.column(1).to_pylist():
            ids, said = c.encode(t or "")
            n.append(len(ids))
            if with_ids:
                every.append(ids)
            a.append(hashlib.sha256(said.encode()).hexdigest())
            b.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return [batch.column(0), n, *([every] if with_ids else []), a, b]

    rows = as_row(docs, keep, F.col(text).cast("string").alias("text"))
    made = fields("n_tokens bigint" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string")
    return map_batches(rows, of, T.StructType([rows.schema["row"], *made.fields]), text=1)


def decode_documents(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Columns `row` and decoded: the text that the ids stand for; null ids decode to the empty text."""
    path = path or tokenizer_path("word_bpe_49k.json")
    rows = as_row(encoded, None, F.col(ids).cast("array<bigint>").alias("ids"))
    schema = T.StructType([rows.schema["row"], *fields("decoded string").fields])
    return map_batches(rows, lambda batch: [batch.column(0), [codec(path).decode(i or []).decode("utf-8") for i in batch.column(1).to_pylist()]], schema)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode_documents(table(spark, sf_dir, "documents"), with_ids=False, keep=("doc_id",))
    return made.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
