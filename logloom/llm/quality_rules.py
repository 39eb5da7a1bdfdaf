"""Operator 8, quality rules: tokeniser fertility with rejection bands per language."""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import SPACES, as_row, fields, map_batches, table, tokenizer_path
from logloom.sources.shared import settle

SYMBOLS = "#*$%&|<>"
METRICS = ("chars_per_token", "byte_share", "token_entropy", "chars_per_multi_token")
_SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double, chars_per_multi_token double, script string"


@dataclass(frozen=True)
class FertilityBands:
    """Production parameters.

    vocabulary: pieces with byte fallback, for the first three measures; multi: byte-level pieces
    for many languages, for characters per token of a second vocabulary. grid: measures are
    counted in steps of 1 / grid, from which quartiles follow exactly. reach: a band runs from the lower quartile less reach interquartile ranges to the upper
    quartile and as much. least: margins beyond the quartiles that no band falls below, so
    that uniform documents reject no ordinary ones. size_base: texts whose token counts have
    the same logarithm to this base share a band, as all three measures scatter less in longer
    texts. min_texts: a language and size of fewer texts takes the texts of the nearest sizes of
    its language as well, until there are as many; a language of fewer texts is judged by the
    whole corpus in the same way, which has no such bound itself.
    min_words: shorter texts are judged by the base rules alone, since a handful of tokens says
    nothing about fertility. window: words of a repeated passage.
    """

    vocabulary: str = "piece_bpe_32k.model"
    multi: str = "byte_bpe_multi_50k.tiktoken"
    grid: int = 1000
    reach: float = 2.2
    least: tuple[float, ...] = (0.05, 0.02, 0.02, 0.05)
    size_base: float = 2.0
    min_texts: int = 50
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8


@lru_cache(maxsize=2)
def _pieces(path: str):
    """The tokeniser, and which of its ids stand for single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sp, np.array([sp.is_byte(i) for i in range(sp.vocab_size())])


@lru_cache(maxsize=2)
def _multi(path: str):
    """A byte-level tokeniser from a file of ranks, split by the pattern that its package states."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def repeat_words(words: list[bytes], ids: dict[bytes, int], window: int = 8) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included.

    Words get numbers, and numbers of pairs, fours and eights follow from sorting pairs of
    numbers, so windows are compared exactly. window must be a power of two.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(np.unique(code)) == len(code):
        return 0
    step = 1
    while step < window:
        pair = code[:-step] * (int(code.max()) + 1) + code[step:]
        code = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        step *= 2
    often = np.bincount(code)[code] > 1
    if not often.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


#: Scripts told apart for texts whose language is not given, by their first code points.
_SCRIPTS = (("latin", re.compile("[A-Za-zÀ-ɏ]")), ("greek", re.compile("[Ͱ-Ͽ]")), ("cyrillic", re.compile("[Ѐ-ӿ]")), ("arabic", re.compile("[؀-ۿ]")), ("han", re.compile("[぀-ヿ一-鿿]")))


def script_of(text: str) -> str:
    """The script of most letters; ties go to the first listed, no letter of any gives `other`."""
    counts = [(len(p.findall(text)), -k, name) for k, (name, p) in enumerate(_SCRIPTS)]
    most = max(counts)
    return most[2] if most[0] else "other"


def measure(docs: DataFrame, text: str = "text", lang: str = "lang", bands: FertilityBands = FertilityBands(), path: str | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns `row` (of docs, all or those of keep, as a struct), `band_group` and the measures of each text."""
    path, multi_path = path or tokenizer_path(bands.vocabulary), tokenizer_path(bands.multi)
    window = bands.window

    def of(batch: pa.RecordBatch) -> list:
        (sp, is_byte), multi = _pieces(path), _multi(multi_path)
        out: list[list] = [[] for _ in range(11)]
        for t, l in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            t = t or ""
            raw = t.encode("utf-8", "replace")
            words = raw.split()
            lines = [x for x in raw.split(b"\n") if x.strip()]
            ids = np.array(sp.encode(t, num_threads=1), np.int64)
            n, n_multi = len(ids), len(multi.encode_ordinary(t))
            count = np.bincount(ids) if n else np.zeros(1)
            p = count[count > 0] / max(n, 1)
            chars = len(t) - sum(map(t.count, SPACES))
            for k, v in enumerate((
                len(words), chars, sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words, {}, window), n,
                chars / n if n else None, float(is_byte[ids].mean()) if n else None,
                float(-(p * np.log2(p)).sum() / np.log2(n)) if n > 1 else None, chars / n_multi if n_multi else None, script_of(t) if l is None else None,
            )):
                out[k].append(v)
        return [batch.column(0), batch.column(2), *out]

    rows = as_row(docs, keep, F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang") if lang in docs.columns else F.lit(None).cast("string").alias("lang"))
    schema = T.StructType([rows.schema["row"], rows.schema["lang"], *fields(_SCHEMA).fields])
    return map_batches(rows, of, schema, text=1, loaders=(_pieces, _multi)).withColumn("band_group", F.coalesce(F.col("lang"), F.concat(F.lit("script:"), "script"))).withColumn("band_size", F.floor(F.log(bands.size_base, F.greatest("n_tokens", F.lit(1)))).cast("int")).drop("lang", "script")


def _nearest_sizes(at: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """Columns band_group, band_size and src_size: the nearest sizes of the group that together hold `least` texts, or all."""
    near = at.join(counts.withColumnRenamed("band_size", "src_size"), "band_group").withColumn("far", F.abs(F.col("band_size") - F.col("src_size")))
    to = Window.partitionBy("band_group", "band_size")
    own = F.sum("n").over(Window.partitionBy("band_group", "band_size", "far"))
    return near.withColumn("own", own).withColumn("upto", F.sum("n").over(to.orderBy("far"))).where(F.col("upto") - F.col("own") < least).select("band_group", "band_size", "src_size")


def _quartiles(steps: DataFrame, sizes: DataFrame, on: list[str]) -> DataFrame:
    """The lower and upper quartile of each measure, in steps, over the sizes that a band takes."""
    of = ["band_group", "band_size", "metric"]
    met = steps.withColumnRenamed("band_size", "src_size").join(sizes, on).groupBy(*of, "step").agg(F.sum("n").alias("n"))
    upto = met.withColumn("upto", F.sum("n").over(Window.partitionBy(*of).orderBy("step"))).withColumn("all", F.sum("n").over(Window.partitionBy(*of)))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("step")))
    return upto.groupBy(*of).agg(at(0.25).alias("lower"), at(0.75).alias("upper"))


def band_table(measured: DataFrame, bands: FertilityBands = FertilityBands()) -> DataFrame:
    """One row per language (or script) and size of text: the lower and upper limit of each measure.

    Quartiles come from all texts of at least min_words words, counted by steps of each measure:
    a task sends one count per language, size and step, however many of the rows a language
    holds, and counts add up to the same in any order. Every language and size that has such a
    text has a band.
    """
    long_enough = measured.where(F.col("n_words") >= bands.min_words)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.floor(F.col(m) * bands.grid).alias("step")) for k, m in enumerate(METRICS)])).alias("x")
    steps = settle(long_enough.select("band_group", "band_size", each).groupBy("band_group", "band_size", "x.metric", "x.step").agg(F.count(F.lit(1)).alias("n")))
    counts = steps.where("metric = 0").groupBy("band_group", "band_size").agg(F.sum("n").alias("n"))
    told = counts.withColumn("few", F.sum("n").over(Window.partitionBy("band_group")) < bands.min_texts)
    own = _nearest_sizes(told.where("NOT few").select("band_group", "band_size"), counts, bands.min_texts)
    q = _quartiles(steps, own, ["band_group", "src_size"])
    whole = counts.groupBy("band_size").agg(F.sum("n").alias("n")).select(F.lit("").alias("band_group"), "band_size", "n")
    few = told.where("few").select("band_group", "band_size")
    sizes = _nearest_sizes(few.select(F.lit("").alias("band_group"), "band_size").distinct(), whole, bands.min_texts)
    of_all = _quartiles(steps.drop("band_group"), sizes, ["src_size"]).drop("band_group")
    q = q.unionByName(few.join(of_all, "band_size").select(*q.columns))
    out = []
    for k, (m, least) in enumerate(zip(METRICS, bands.least, strict=True)):
        own = lambda c, k=k: F.max(F.when(F.col("metric") == k, F.col(c))) / bands.grid
        reach = F.greatest(bands.reach * (own("upper") - own("lower")), F.lit(least))
        out += [(own("lower") - reach).alias(f"{m}_low"), (own("upper") + 1 / bands.grid + reach).alias(f"{m}_high")]
    return q.groupBy("band_group", "band_size").agg(*out)


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", bands: FertilityBands = FertilityBands(), path: str | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Judge every document. Columns: `row`, the measures, base_failed and kept.

    A text fails the base rules below min_words words or with more than max_repeat_percent of
    its words in repeated windows. Of the others the method rejects those outside a band of
    their language: characters per token of either vocabulary, share of byte-fallback tokens, or
    token entropy over its greatest possible value. Low bands of byte_share and high bands of entropy reject
    nothing, being the good end.

    Null texts count as empty: no words, so base_failed. A null language is judged among the
    texts of its script. Repeated rows are judged alike, each on its own. An empty table gives
    an empty result. Columns of docs are kept inside `row`, whatever their names.
    """
    measured = settle(measure(docs, text, lang, bands, path, keep))
    judged = measured.join(settle(band_table(measured, bands)), ["band_group", "band_size"], "left")  # a small file: joined by broadcast, by shuffle beyond the threshold
    failed = (F.col("n_words") < bands.min_words) | (100 * F.col("n_repeat_words") > bands.max_repeat_percent * F.col("n_words"))
    outside = (
        (F.col("chars_per_token") < F.col("chars_per_token_low")) | (F.col("chars_per_token") > F.col("chars_per_token_high"))
        | (F.col("chars_per_multi_token") < F.col("chars_per_multi_token_low")) | (F.col("chars_per_multi_token") > F.col("chars_per_multi_token_high"))
        | (F.col("byte_share") > F.col("byte_share_high")) | (F.col("token_entropy") < F.col("token_entropy_low"))
    )
    return judged.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_tokens", *METRICS,
        F.when(failed, F.lit(False)).otherwise(~F.coalesce(outside, F.lit(False))).alias("kept"),
    )


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The documents that quality_rules keeps, with their own columns."""
    return quality_rules(docs, **how).where("kept").select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return judged.select("row.doc_id", *[c for c in judged.columns if c != "row"])
