"""A trigram index over texts, kept as Parquet tables in a folder: generations of postings, tombstones, compaction.

Folder: texts (text_id, key, text), postings (gram, high, low), grams (gram, n), docs (text_id,
session, file, line) and gone (file), each by generation; postings and grams also by bucket of the
gram, texts by block of the id, so that a search opens the few folders that it asks for. A posting
lists the texts of a batch that hold a gram: their ids share `high`, and `low` are the other 31 bits. A generation counts
once `commits` names it, which is written last: what a failed writer leaves is written over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.operators.search import folded, needle_of, trigrams
from logloom.sources.shared import settle


@dataclass(frozen=True)
class Layout:
    """buckets: folders of a generation's postings. blocks: folders of its texts. few: candidates up to which a search names them to the scan; more are joined. grams, worth: a search reads the postings of its rarest trigram and of so many more at most, while none has over `worth` times as many."""

    buckets: int = 64
    blocks: int = 64
    few: int = 1000
    grams: int = 4
    worth: int = 8


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text, A-Z in lower case; in time in proportion to its length."""
    # Zipped and not looked up by place: what a lambda takes from outside is worked out anew for every element.
    chars = F.split(folded(text), "")
    zipped = F.arrays_zip(chars.alias("a"), F.slice(chars, 2, F.length(text)).alias("b"), F.slice(chars, 3, F.length(text)).alias("c"))
    three = F.filter(F.transform(zipped, lambda z: F.concat(z["a"], z["b"], z["c"])), lambda g: g.isNotNull())
    return F.array_distinct(F.when(F.length(text) > 2, three).otherwise(F.array().cast("array<string>")))


#: Bytes of text whose postings a task makes at once; a longer text is worked on alone.
_AT_ONCE = 4 << 20
#: Bits of a character's number, and of an id that postings keep apart.
_CHAR, _LOW = 21, 31


def _grams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, each as one number."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.unique((c[:-2] << np.uint64(2 * _CHAR)) | (c[1:-1] << np.uint64(_CHAR)) | c[2:]) if len(c) > 2 else c[:0]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) // _AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns gram, high, low of texts (text_id, text) with A-Z in lower case: for each gram the texts of a slice that hold it."""
    for whole in batches:
        for batch in _slices(whole):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            found = [_grams(t) for t in batch.column(1).to_pylist()]
            gram = np.concatenate([np.zeros(0, np.uint64), *[found[k] for k in order]])
            of = np.repeat(ids[order], [len(found[k]) for k in order])
            by = np.argsort(gram, kind="stable")
            gram, of = gram[by], of[by]
            high = of >> _LOW
            first = np.flatnonzero(np.append(True, (np.diff(gram) != 0) | (np.diff(high) != 0))[: len(gram)])
            chars = np.stack([(gram[first] >> np.uint64(k * _CHAR)) & np.uint64((1 << _CHAR) - 1) for k in (2, 1, 0)], axis=1).astype(np.uint32)
            said = chars.tobytes().decode("utf-32-le")
            low = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)).astype(np.int32)), pa.array((of & ((1 << _LOW) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([said[k : k + 3] for k in range(0, len(said), 3)], pa.string()), pa.array(high[first]), low], names=["gram", "high", "low"])


def _each(postings: DataFrame) -> DataFrame:
    """Columns gram, text_id."""
    return postings.select("gram", "high", F.explode("low").alias("low")).select("gram", F.expr(f"shiftleft(high, {_LOW}) | low").alias("text_id"))


class TrigramIndex:
    """Documents (session, file, line, text) found by substrings of three characters or more.

    One writer at a time. A null text is not indexed; a text is kept once however many documents
    hold it. Texts that no document holds any more cost space until compact().
    """

    def __init__(self, spark: SparkSession, root: str, layout: Layout = Layout()):
        self.spark, self.root, self.layout = spark, root.rstrip("/"), layout

    def _range(self) -> tuple[int, int]:
        """The generations that count: from the last compaction on; (0, -1) for an empty index."""
        try:
            last = self.spark.read.schema("gen int, base int").parquet(f"{self.root}/commits").agg(F.max_by(F.struct("base", "gen"), "gen").alias("c")).first()["c"]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        return (last["base"], last["gen"]) if last else (0, -1)

    _SCHEMAS = {"texts": "text_id long, key string, text string, gen int, block int", "postings": "gram string, high long, low array<int>, gen int, bucket int", "grams": "gram string, n long, gen int, bucket int", "docs": "text_id long, session string, file string, line long, gen int", "gone": "file string, gen int"}

    def _table(self, name: str) -> DataFrame:
        base, last = self._range()
        if last < 0:
            return self.spark.createDataFrame([], self._SCHEMAS[name])
        return self.spark.read.schema(self._SCHEMAS[name]).option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/gen={g}" for g in range(base, last + 1)])

    def _write(self, rows: DataFrame, name: str, gen: int, *folders: str) -> None:
        rows.write.mode("overwrite").partitionBy(*folders).parquet(f"{self.root}/{name}/gen={gen}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("gram"), F.lit(self.layout.buckets)).cast("int").alias("bucket")

    def _write_postings(self, texts: DataFrame, gen: int) -> None:
        made = texts.where("text IS NOT NULL").select("text_id", folded(F.col("text")).alias("text")).mapInArrow(_postings, "gram string, high long, low array<int>")
        # Written once, as ranges are found by reading them; dealt down to the texts, so a trigram of every text fills several tasks.
        placed = settle(made.withColumn("bucket", self._bucket()))
        self._write(placed.repartitionByRange("bucket", "gram", "high", F.col("low")[0]).sortWithinPartitions("bucket", "gram", "high"), "postings", gen, "bucket")
        counts = placed.groupBy("bucket", "gram").agg(F.sum(F.size("low")).alias("n"))
        self._write(counts.repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram"), "grams", gen, "bucket")

    def _commit(self, gen: int, base: int) -> None:
        self.spark.createDataFrame([(gen, base)], "gen int, base int").coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def documents(self) -> DataFrame:
        """The documents that are not deleted or replaced: text_id, session, file, line."""
        gone = self._table("gone").groupBy(F.col("file").alias("gone_file")).agg(F.max("gen").alias("until"))
        docs = self._table("docs")
        return docs.join(gone, (F.col("file") == F.col("gone_file")) & (F.col("gen") < F.col("until")), "left_anti").select("text_id", "session", "file", "line")

    def update(self, docs: DataFrame | None = None, without: DataFrame | None = None) -> None:
        """One generation: the documents of the files in `without` (file) go, then docs are added. A replaced file is in both."""
        base, last = self._range()
        gen = last + 1
        if docs is None:
            docs = self.spark.createDataFrame([], "session string, file string, line long, text string")
        said = docs.where(F.col("text").isNotNull()).select(F.col("session").cast("string"), F.col("file").cast("string"), F.col("line").cast("long"), F.sha2("text", 256).alias("key"), "text")
        known = self._table("texts").select("text_id", "key")
        fresh = settle(said.groupBy("key").agg(F.first("text").alias("text"), F.min("line").alias("line")).join(known, "key", "left_anti").repartitionByRange("line", "key"))
        # Unique without a count of all: the generation, the task and the row in it; written once, so they stay.
        numbered = settle(fresh.select((F.lit(gen).cast("long") * (1 << 48) + F.monotonically_increasing_id()).alias("text_id"), "key", "text"))
        self._write(numbered.withColumn("block", F.pmod(F.xxhash64("text_id"), F.lit(self.layout.blocks)).cast("int")).repartition("block").sortWithinPartitions("block", "text_id"), "texts", gen, "block")
        self._write_postings(numbered, gen)
        ids = known.unionByName(numbered.select("text_id", "key"))
        self._write(said.drop("text").join(ids, "key").select("text_id", "session", "file", "line"), "docs", gen)
        self._write((without if without is not None else docs.limit(0)).select(F.col("file").cast("string")).distinct(), "gone", gen)
        self._commit(gen, base if last >= 0 else gen)

    def compact(self) -> None:
        """Write all that still counts as one generation: no tombstones, and no texts without documents."""
        gen = self._range()[1] + 1
        docs = settle(self.documents())
        used = docs.select("text_id").distinct()
        self._write(self._table("texts").join(used, "text_id", "left_semi").select("text_id", "key", "text", "block").repartition("block").sortWithinPartitions("block", "text_id"), "texts", gen, "block")
        # Postings are many times the texts once they are taken apart, so they are made anew of the texts that stay.
        self._write_postings(self.spark.read.schema(self._SCHEMAS["texts"]).parquet(f"{self.root}/texts/gen={gen}"), gen)
        self._write(docs, "docs", gen)
        self._write(docs.select("file").limit(0), "gone", gen)
        self._commit(gen, gen)

    def _of_grams(self, name: str, grams: list[str]) -> DataFrame:
        buckets = {r["bucket"] for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(self._bucket()).collect()}
        return self._table(name).where(F.col("bucket").isin(*sorted(buckets)) & F.col("gram").isin(*grams))

    def _holders(self, grams: list[str]) -> DataFrame:
        """Ids of the texts that hold all of the trigrams."""
        return _each(self._of_grams("postings", grams)).groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("text_id")

    def _rarest(self, grams: list[str]) -> list[str]:
        """The trigrams whose postings a search reads, rarest first; none if one of all occurs nowhere."""
        counts = {r["gram"]: r["n"] for r in self._of_grams("grams", grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # 64 at most
        if len(counts) < len(grams):
            return []
        ranked = sorted(grams, key=lambda g: (counts[g], g))
        return [g for g in ranked[: self.layout.grams] if counts[g] <= self.layout.worth * counts[ranked[0]]]

    def candidates(self, query: str, cap: int = 4096) -> DataFrame:
        """Columns text_id, truncated: texts with a document that hold every trigram of the query, the first indexed first, `cap` at most."""
        needle = needle_of(query)
        if not needle:
            return self.spark.createDataFrame([], "text_id long, truncated boolean")
        found = self._holders(trigrams(needle)).join(self.documents(), "text_id", "left_semi").orderBy("text_id").limit(cap + 1)
        place, n = F.row_number().over(Window.orderBy("text_id")), F.count(F.lit(1)).over(Window.partitionBy())  # of cap + 1 rows
        return found.select("text_id", place.alias("place"), (n > cap).alias("truncated")).where(F.col("place") <= cap).select("text_id", "truncated")

    def matching_texts(self, query: str) -> DataFrame:
        """Columns text_id, matches: every indexed text that holds the query, A-Z in either case, and how often without overlap."""
        needle = needle_of(query)
        chosen = self._rarest(trigrams(needle)) if needle else []
        if not chosen:
            return self.spark.createDataFrame([], "text_id long, matches long")
        ids = settle(self._holders(chosen))
        texts = self._table("texts")
        some = ids.limit(self.layout.few + 1).withColumn("block", F.pmod(F.xxhash64("text_id"), F.lit(self.layout.blocks)).cast("int")).collect()
        if len(some) <= self.layout.few:
            texts = texts.where(F.col("block").isin(*sorted({r["block"] for r in some})) & F.col("text_id").isin(*[r["text_id"] for r in some]))
        else:
            texts = texts.join(ids, "text_id", "left_semi")
        text = folded(F.col("text"))
        count = (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)
        return texts.where(F.contains(text, F.lit(needle))).select("text_id", count.cast("bigint").alias("matches"))

    def hits(self, query: str) -> DataFrame:
        """Columns session, file, line, matches: every document that holds the query."""
        return self.documents().join(self.matching_texts(query), "text_id").select("session", "file", "line", "matches")
