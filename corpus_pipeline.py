"""A corpus pipeline of five stages, each one of the operators of logloom.llm.

Near-duplicate removal joins documents that share four fifths of their 5-word shingles. Every stage takes
(spark, docs, sf_dir), works on all that the one before it kept, and returns the columns of
documents; the last one returns the encoding of each document of the mix. Columns of any other name
are carried along, an empty table gives an empty one, and texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm.bpe_codec import encode_documents
from logloom.llm.near_copies import first_of_near_copies
from logloom.llm.quality_rules import keep_good
from logloom.llm.secret_scan import without_secrets
from logloom.llm.source_mix import mixed_documents
from logloom.sources.shared import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts have too few words. A null lang is judged by the text's script; repeated rows share a verdict."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8) stays, the one of the smallest id.

    Texts without words are copies of each other; a null id is never the smallest; of repeated rows one stays.
    """
    return first_of_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, repeated rows too; secrets in its text give way to a mark. A null text stays null."""
    return without_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, at most twice each, or left out so that each source reaches its target of words.

    A null source is a source of its own; documents without words, null texts among them, are left out.
    """
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document of the mix with its token ids, and digests of them and of what they decode to; a null text has none."""
    return encode_documents(docs, keep=("doc_id", "source")).select("row.doc_id", "row.source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", quality), ("simhash_dedup", near_duplicates), ("secret_scan", secrets), ("source_mix", mixing), ("bpe_codec", encoding)]

#: Fertility bands, a trained network and hash draws have no SQL form; the tests hold the
#: pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
