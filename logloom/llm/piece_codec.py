"""Operator 12, SentencePiece encoding and decoding of merge-type models: backtracking over longest matches."""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import as_row, fields, map_batches, table, tokenizer_path

#: Fixed values of the model format: the mark that stands for a blank, kinds of pieces, the merge type, the text of an unknown piece.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGE_TYPE = 2
UNKNOWN_TEXT = " ⁇ "
#: Distinct words, and pairs of neighbours, whose results a worker keeps; later ones are worked out each time.
MEMO_WORDS = 200_000
MEMO_PAIRS = 500_000


def _messages(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers as such, all else as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, data[at : at + size]
        at += size


def _replace(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("logloom-each-byte", _replace)


class PieceCodec:
    """Encode as merging neighbours by score would, without a merge queue over the text.

    Merging joins the two neighbours whose joint text has the best score, leftmost first, until no
    two neighbours form a piece. Its result is the one sequence in which every two neighbours are
    what merging makes of their joint text: what merging does to two neighbours does not depend on
    the rest unless a border is crossed, and the first crossing would show in the two alone. So
    the encoder takes the longest piece at each place, checks it against the piece before by
    merging the two again, steps to shorter pieces while they do not fit, and goes back when none
    fits; a bit for each place says that it has failed, so no place is tried twice.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_messages(f.read()))
        trainer = dict(chain.from_iterable(_messages(v) for k, v in parts if k == 2))
        normal = dict(chain.from_iterable(_messages(v) for k, v in parts if k == 3))
        pieces = [{1: b"", 2: bytes(4), 3: NORMAL} | dict(_messages(v)) for k, v in parts if k == 1]
        if trainer.get(3, 1) != MERGE_TYPE or not trainer.get(35, 0):
            raise ValueError("the model must be of the merge type with bytes for unknown characters")
        if normal.get(2, b"") or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("the model must leave texts as they are, but for blanks")
        if {p[3] for p in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model must not have pieces of a user or unused ones")
        self.prefix = " " if normal.get(3, 1) else ""
        texts = [p[1].decode().replace(BLANK, " ") for p in pieces]
        self.text = texts
        self.number = {t: k for k, (t, p) in enumerate(zip(texts, pieces, strict=True)) if p[3] == NORMAL}
        self.score = {t: struct.unpack("<f", pieces[k][2])[0] for t, k in self.number.items()}
        byte = {int(t[3:5], 16): k for k, (t, p) in enumerate(zip(texts, pieces, strict=True)) if p[3] == BYTE}
        self.byte = [byte[b] for b in range(256)]
        # A character of no longer piece merges with nothing, and a blank only with what follows
        # it if no piece has one after another character: texts fall apart there.
        joins = set(chain.from_iterable(t for t in self.number if len(t) > 1))
        if not joins <= set(self.number):
            raise ValueError("every character of a longer piece must be a piece")
        self.single = {c: (k,) for c, k in self.number.items() if len(c) == 1}
        inner = re.escape("".join(sorted(joins - {" "})))
        apart = all(" " not in t.lstrip(" ") for t in self.number)
        if not joins:
            self.words = re.compile(r"[\s\S]")
        elif apart and " " in joins:
            self.words = re.compile(f" *[{inner}]+| +|[^{inner}]" if inner else r" +|[^ ]")
        else:
            every = re.escape("".join(sorted(joins)))
            self.words = re.compile(f"[{every}]+|[^{every}]")
        self.length = [len(t) for t in texts]
        self.shorter = [-1] * len(texts)
        for t, k in self.number.items():
            self.shorter[k] = next((self.number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.number), -1)
        self.matcher = ahocorasick.Automaton()
        for t, k in self.number.items():
            self.matcher.add_word(t, k)
        self.matcher.make_automaton()
        self.fits: dict[int, bool] = {}  # by the first piece, shifted, and the second
        self.memo: dict[str, tuple[int, ...]] = {}
        self.decimal = [str(k) for k in range(len(texts))]
        # Decoding: the bytes of all ids behind one another, and where each begins.
        said = [bytes([self.byte.index(k)]) if p[3] == BYTE else b"" if p[3] == CONTROL else UNKNOWN_TEXT.encode() if p[3] == UNKNOWN else t.encode() for k, (t, p) in enumerate(zip(texts, pieces, strict=True))]
        self.silent = {k for k, p in enumerate(pieces) if p[3] == CONTROL}
        self.leads = {k for k, (t, p) in enumerate(zip(texts, pieces, strict=True)) if p[3] == NORMAL and t.startswith(" ")} if self.prefix else set()
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in said])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(said), np.uint8)

    def merge(self, text: str) -> list[str]:
        """What merging by score makes of a short text."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay the two pieces that they are when their joint text is merged again; a = -1: b alone."""
        text = self.text
        known = self.merge(text[b]) == [text[b]] if a < 0 else self.merge(text[a] + text[b]) == [text[a], text[b]]
        if a >= 0 and len(self.fits) < MEMO_PAIRS:
            self.fits[a << 20 | b] = known
        return known

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a stretch of text in which every character is a piece or part of one."""
        size, length, fits = len(word), self.length, self.fits
        if size == 1:
            return self.single.get(word) or tuple(self.byte[b] for b in word.encode("utf-8", "surrogatepass"))
        longest = [-1] * size
        for end, piece in self.matcher.iter(word):  # ends ascend, so a longer match replaces a shorter one
            longest[end + 1 - length[piece]] = piece
        failed, out, at, piece, before = bytearray(size // 8 + 1), [], 0, longest[0], -1
        while at < size:
            end = at + length[piece]
            fit = fits.get(before << 20 | piece) if before >= 0 else True if end < size else None
            if fit is None:
                fit = self.compatible(before, piece)
            if fit and not failed[end >> 3] >> (end & 7) & 1:
                out.append(piece)
                at, before = end, piece
                if at < size:
                    piece = longest[at]
            elif self.shorter[piece] >= 0:
                piece = self.shorter[piece]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= length[piece]
                before = out[-1] if out else -1
        made = tuple(out)
        if len(self.memo) < MEMO_WORDS and size <= 64:
            self.memo[word] = made
        return made

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids of the text, and the same in decimal with commas between."""
        if not text:
            return [], ""
        memo = self.memo
        text = self.prefix + (text.replace(BLANK, " ") if BLANK in text else text)
        ids = list(chain.from_iterable([memo.get(word) or self._word(word) for word in self.words.findall(text)]))
        return ids, ",".join(map(self.decimal.__getitem__, ids))

    def gather(self, ids: list[int]) -> bytes:
        a = np.asarray(ids, np.int64)
        start, size = self.offsets[a], self.offsets[a + 1] - self.offsets[a]
        first = np.cumsum(size) - size
        return self.bytes[np.arange(int(size.sum())) + np.repeat(start - first, size)].tobytes()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, gathered from the offset table, without the blank put before the text."""
        return self.gather(ids)[next((k for k in ids if k not in self.silent), -1) in self.leads :]

    def decode_text(self, ids: list[int]) -> str:
        """The text of any ids: each byte that is part of no character gives U+FFFD, and ids without text part bytes."""
        edges = [-1, *(k for k, i in enumerate(ids) if i in self.silent), len(ids)]
        said = "".join(self.gather(ids[a + 1 : b]).decode("utf-8", "logloom-each-byte") for a, b in zip(edges[:-1], edges[1:], strict=True))
        return said[next((k for k in ids if k not in self.silent), -1) in self.leads :]


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, text: str = "text", path: str | None = None, with_ids: bool = True, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns `row`, n_tokens, ids (array, if with_ids), ids_sha256, decoded_sha256; no begin or end ids.

    A null text is encoded as the empty text: no ids, and digests of nothing. Whole texts of any
    length are encoded; one word of any length takes time in proportion. Characters of no piece
    become the ids of their bytes. Repeated rows are encoded each on its own; an empty table gives
    an empty result; columns of any name are kept within `row`.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")

    def of(batch: pa.RecordBatch) -> list:
        c = codec(path)
        n, every, a, b = [], [], [], []
        for t in batch.column(1):
            ids, said = c.encode(t.as_py() or "")
            n.append(len(ids))
            if with_ids:
                every.append(ids)
            a.append(hashlib.sha256(said.encode()).hexdigest())
            b.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return [batch.column(0), n, *([every] if with_ids else []), a, b]

    rows = as_row(docs, keep, F.col(text).cast("string").alias("text"))
    made = fields("n_tokens bigint" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string")
    return map_batches(rows, of, T.StructType([rows.schema["row"], *made.fields]), text=1)


def decode_pieces(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Columns `row` and decoded: the text of the ids; null or no ids give the empty text, a byte that is part of no character U+FFFD.

    Null elements are passed over. An id that the model lacks is an error.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")
    rows = as_row(encoded, None, F.col(ids).cast("array<bigint>").alias("ids"))
    schema = T.StructType([rows.schema["row"], *fields("decoded string").fields])

    def of(batch: pa.RecordBatch) -> list:
        c = codec(path)
        return [batch.column(0), [c.decode_text([k for k in i or [] if k is not None]) for i in batch.column(1).to_pylist()]]

    return map_batches(rows, of, schema)


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode_pieces(table(spark, sf_dir, "documents"), with_ids=False, keep=("doc_id",))
    return made.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
