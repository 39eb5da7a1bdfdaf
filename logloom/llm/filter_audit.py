"""Operator 13, filter interaction audit: mask histograms times integer matrices, for every order of the filters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import UPPER, WORD, fields, table

#: Orders of the filters grow with the factorial of their number, masks with its power of two.
MOST_FILTERS = 6
#: What one row of the result counts.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")


def outcome_matrices(names: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The (order, step) of each column, and for each outcome a 0/1 matrix of masks by columns.

    Bit k of a mask is set where the k-th filter fails. Times a histogram of masks a matrix gives the
    number of documents with that outcome at each step of each order.
    """
    orders = list(permutations(range(len(names))))
    masks = np.arange(1 << len(names))[:, None]
    at = np.array([f for order in orders for f in order])
    before = np.array([sum(1 << f for f in order[:k]) for order in orders for k in range(len(order))])
    fails, gone = masks >> at & 1, (masks & before) != 0
    made = {"kept": (fails == 0) & ~gone, "removed": (fails == 1) & ~gone, "redundant": (fails == 1) & gone, "unique_fails": masks == 1 << at}
    return [("".join(names[f] for f in order), k + 1) for order in orders for k in range(len(order))], {k: v.astype(np.int64) for k, v in made.items()}


def text_failures(text: Column) -> dict[str, Column]:
    """The four filters of the audit that look at one text; a null text counts as the empty one."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit(f"[{UPPER[0]}-{UPPER[-1]}]"))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def mask_histograms(docs: DataFrame, labels: DataFrame, failures: dict[str, Column], part: Column, copies: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns part, kind (0 all, 1 good, 2 toxic), mask, n: documents by what they fail.

    failures: filters over one text by letter; `copies` is the letter of one more, which a document
    fails if a smaller key has the same text (null as the empty one). Masks have a bit a filter, in
    the order of failures, then copies. Documents of a null key are no copies and make none; several
    of one key and one text are told apart by other keys alone. A document is good or toxic if any
    row of labels with its key says so.

    Labels of a null key label nothing. Texts meet by their digest, and no row of a document is ever joined to its copies: documents
    are counted by digest, part and label first, and the least key of each digest is found among
    those counts, of which a digest has at most four a part.
    """
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures.values())), F.lit(0))
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), part.alias("part"), F.sha2(said.cast("binary"), 256).alias("digest"), mask.cast("int").alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    rows = rows.join(known, "id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    groups = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unknown"),
    )
    overall = groups.groupBy(F.col("digest").alias("of")).agg(F.min("least").alias("first"))
    groups = groups.join(overall, F.col("digest") == F.col("of"))
    first = F.col("unknown") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    bit = F.lit(1 << len(failures))
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), first.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - first).alias("n"))))
    kinds = F.explode(F.filter(F.array(F.lit(0), F.when(F.col("good"), 1), F.when(F.col("toxic"), 2)), lambda k: k.isNotNull()))
    return groups.select("part", "good", "toxic", split.alias("s")).select("part", kinds.alias("kind"), "s.mask", "s.n").groupBy("part", "kind", "mask").agg(F.sum("n").alias("n"))


def audit(histograms: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    histograms: columns part, kind, mask, n as mask_histograms() gives them; a mask counts once a kind
    however many rows it comes in. A part is one row of three histograms, so a task holds the parts of a batch. An empty table gives
    no rows; a part without labelled documents has zeros.
    """
    if not 0 < len(names) <= MOST_FILTERS or len(set(names)) != len(names):
        raise ValueError(f"names must be 1 to {MOST_FILTERS} different letters")
    size = 1 << len(names)
    entries = F.collect_list(F.struct((F.col("kind") * size + F.col("mask")).cast("int").alias("at"), F.col("n").alias("n")))  # 3 * size at most: n is summed
    parts = histograms.groupBy("part", "kind", "mask").agg(F.sum("n").alias("n")).groupBy("part").agg(entries.alias("entries"))
    schema = fields("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, matrices = outcome_matrices(names)
        orders, steps = pa.array([o for o, _ in columns]), pa.array([s for _, s in columns], pa.int32())
        filters = np.array([names.index(o[s - 1]) for o, s in columns])
        of_filter = (filters[:, None] == np.arange(len(names))).astype(np.int64)
        for batch in batches:
            for part, entry in zip(batch.column(0), batch.column(1), strict=True):
                stack = np.zeros(3 * size, np.int64)
                for e in entry.as_py():
                    stack[e["at"]] = e["n"]
                stack = stack.reshape(3, size)
                made = {k: stack @ m for k, m in matrices.items()}
                shapley = (made["removed"][0] @ of_filter)[filters]
                counts = [*(made[k][0] for k in OUTCOMES), made["removed"][1], made["removed"][2], shapley]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(columns), pa.string()), orders, steps, *map(pa.array, counts)], names=schema.names)

    return parts.mapInArrow(run, schema)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters by language; a null language is the empty string.

    A: under 200 words. B: under half of the words distinct. C: over 3 % capitals A-Z. D: a character
    of #$%&*|. E: the text of a smaller doc_id. Null and empty texts are one text; extra columns of
    any name are not read.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    return audit(mask_histograms(docs, labels, text_failures(F.col("text").cast("string")), lang, "E"), "ABCDE")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, list_filter(regexp_extract_all(coalesce(text, ''), '{WORD}'), lambda w: w <> '') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT AS fa, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS fb, (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT AS fc,
    regexp_matches(t, '[#$%&*|]')::INT AS fd, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), FALSE)::INT AS fe
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
),
h AS (SELECT part, fa, fb, fc, fd, fe, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM f GROUP BY ALL),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS c, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) r(step)),
m AS (
  SELECT part, filter_order, step, c, n, n_good, n_toxic, fa + fb + fc + fd + fe AS fails,
    CASE c WHEN 'A' THEN fa WHEN 'B' THEN fb WHEN 'C' THEN fc WHEN 'D' THEN fd ELSE fe END AS own,
    greatest(fa * contains(earlier, 'A')::INT, fb * contains(earlier, 'B')::INT, fc * contains(earlier, 'C')::INT, fd * contains(earlier, 'D')::INT, fe * contains(earlier, 'E')::INT) AS gone
  FROM h, s
),
r AS (
  SELECT part, filter_order, step, c, sum(CASE WHEN own = 0 AND gone = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN own = 1 AND gone = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN own = 1 AND gone = 1 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own = 1 AND fails = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN own = 1 AND gone = 0 THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN own = 1 AND gone = 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM m GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley
FROM r
"""
