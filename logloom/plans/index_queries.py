"""Queries through the trigram index, each with its SQL over the plain tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from logloom.operators import search as S
from logloom.plans.session_queries import NEEDLE
from logloom.sources.shared import shared_dir
from logloom.sources.trigram_index import TrigramIndex
from logloom.sources.views import document_view, with_views


def _index(spark, sf_dir, compacted: bool) -> TrigramIndex:
    """All documents; then those of one file go and those of another come anew with more text."""
    docs = document_view(spark, sf_dir)
    index = TrigramIndex(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    index.update(docs)
    anew = docs.where("file = 'fr'").withColumn("text", F.concat("text", F.lit(" the Licensee")))
    index.update(anew, without=docs.where("file IN ('de', 'fr')").select("file"))
    if compacted:
        index.compact()
    return index


_NOW = with_views("v_doc") + ", now AS (SELECT session, file, line, CASE WHEN file = 'fr' THEN text || ' the Licensee' ELSE text END AS text FROM v_doc WHERE file <> 'de')"
_FOLD = f"translate(text, '{S.UPPER}', '{S.LOWER}')"
_N = NEEDLE.lower()
_HITS = _NOW + f" SELECT session, file, line, (length({_FOLD}) - length(replace({_FOLD}, '{_N}', ''))) // {len(_N)} AS matches FROM now WHERE contains({_FOLD}, '{_N}')"

QUERIES = {
    "search_index_hits": (lambda s, d: _index(s, d, False).hits(NEEDLE), _HITS),
    "search_index_compacted": (lambda s, d: _index(s, d, True).hits(NEEDLE), _HITS),
}
