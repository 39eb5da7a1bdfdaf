"""Queries of the operators in this folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.llm.bpe_codec import op4_bpe_codec
from logloom.llm.filter_audit import OP13_ORACLE, op13_filter_audit
from logloom.llm.language_id import op5_language_id
from logloom.llm.license_scan import op6_license_scan
from logloom.llm.periodic_runs import op11_periodic_runs
from logloom.llm.piece_codec import op12_piece_codec
from logloom.llm.pivot_search import OP2_ORACLE, op2_pivot_search
from logloom.llm.quality_rules import op8_quality_rules
from logloom.llm.recurrent_lm import op1_recurrent_lm
from logloom.llm.secret_scan import op3_secret_scan
from logloom.llm.simhash_dedup import op9_simhash_dedup
from logloom.llm.source_mix import op10_source_mix
from logloom.llm.url_filter import op7_oracle, op7_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {q.__name__: q for q in (op1_recurrent_lm, op2_pivot_search, op3_secret_scan, op4_bpe_codec, op5_language_id, op6_license_scan, op7_url_filter, op8_quality_rules, op9_simhash_dedup, op10_source_mix, op11_periodic_runs, op12_piece_codec, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op2_pivot_search": OP2_ORACLE, "op7_url_filter": op7_oracle(), "op13_filter_audit": OP13_ORACLE}
