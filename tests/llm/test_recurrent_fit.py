"""The recurrent weights learn from every training text, at every size."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import recurrent_lm
from logloom.llm.recurrent_lm import RecurrentLm, language_model_scores


def test_op1_fits_to_all_training_texts(spark, monkeypatch):
    fit, seen = recurrent_lm.fit_model, []

    def counted(texts, vocabulary, how):
        seen.append(texts.count())
        return fit(texts, vocabulary, how)

    monkeypatch.setattr(recurrent_lm, "fit_model", counted)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id") % 7).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5).cast("bigint").alias("n_chars"))
    scored = language_model_scores(docs, F.col("doc_id") % 6 != 0, keep=("doc_id",), how=RecurrentLm(hidden=4, words=10, rounds=1))
    assert seen == [2500] and scored.count() == 3000


def test_op1_one_very_long_text_takes_no_room_in_other_lanes():
    how = RecurrentLm(hidden=2, words=8)
    model = recurrent_lm.Gru(np.arange(1, 12, dtype=np.float64), how)
    texts = [np.arange(20_000, dtype=np.int32) % 11, *[np.array([3, 1, 0], np.int32)] * 500]
    tracemalloc.start()
    scores = model.score(texts)
    assert tracemalloc.get_traced_memory()[1] < 20e6 and np.isfinite(scores).all()
    tracemalloc.stop()
    assert scores[1:] == pytest.approx(scores[1]) and scores[0] == pytest.approx(model.score(texts[:1])[0], rel=1e-4)


def test_op1_averages_copies_by_a_tree(spark):
    values = np.random.default_rng(0).normal(0, 1, (11, 6)).astype(np.float32)
    rows = [(p, c, c + 1, bytearray(values[c, 3 * p : 3 * p + 3].tobytes())) for c in range(11) for p in range(2)]
    copies = spark.createDataFrame(rows, "piece bigint, copy bigint, tokens bigint, weights binary")
    got = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in recurrent_lm._average(copies, 3)])
    assert got == pytest.approx(np.average(values, axis=0, weights=np.arange(1, 12)), rel=1e-4, abs=1e-5)
