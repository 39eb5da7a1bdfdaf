"""Small frames of documents with awkward rows and columns."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = ("ta", "ri", "mo", "ne", "lu", "ka", "so", "ve", "di", "po", "an", "er")
TEXTS = ["", " \t\n", "a", "ein Wort", "Ordnung und Fleiß", "the quick brown fox jumps over the lazy dog", "\n\n\n", "É", "日本", "a\x00b", "x" * 100_000, "word " * 20_000, "\U0001f600 ok"]


def words(n: int, seed: int = 0) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark, rows):
    """(doc_id, text) as documents, with columns whose names clash with what the operators make."""
    full = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    extra = ("row", "fp", "size", "rank", "kept", "n_tokens", "spans", "key", "band_group", "word", "rid", "a.b")
    return documents(spark, full).select("*", *[F.lit(k).alias(c) for k, c in enumerate(extra)])
