"""Operator 7, URL filters: a sorted array of 64-bit digests, probed by binary search."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import LOWER, UPPER, as_row, fields, map_batches, table
from logloom.sources.shared import settle

_FOLD = str.maketrans(UPPER, LOWER)

#: The rules of the query, (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts that the list blocks where no rule fits, under each of the three domains.
LISTED_NAMES = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
LISTED = tuple(("block", f"{name}.example.{top}", "") for name in LISTED_NAMES for top in ("com", "net", "org"))


@dataclass(frozen=True)
class UrlFilter:
    """max_rules, max_bytes: of a list that is laid out as one array for every executor; a larger
    one is joined, which gives the same rows."""

    max_rules: int = 5_000_000
    max_bytes: int = 256 << 20


def split_url(url: str | None) -> tuple[str, str]:
    """Host, its A-Z in lower case, and path; both empty for null and where no :// is."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return rest[:end].translate(_FOLD), tail[:stop]


class DigestArray:
    """Rules as three arrays in the order of their digests: digests, ends of strings, verdicts; a rule of both verdicts allows.

    `packed` is the file's content: digests, ends, sizes of hosts, verdicts, strings.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        keys: dict[tuple[str, str], bool] = {}
        for verdict, host, path in rules:
            key = host.translate(_FOLD), path
            keys[key] = keys.get(key, False) or verdict == "allow"
        rows = sorted((xxhash.xxh64_intdigest(h + p), (h + p).encode(), allow, len(h)) for (h, p), allow in keys.items())
        self.n = len(rows)
        self.packed = b"".join((
            np.array([r[0] for r in rows], np.uint64).tobytes(), np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int64).tobytes(),
            np.array([r[3] for r in rows], np.int32).tobytes(), np.array([r[2] for r in rows], np.uint8).tobytes(), b"".join(r[1] for r in rows),
        ))
        self.path_sizes = sorted({len(p) for _, p in keys})
        self.host_labels = sorted({h.count(".") + 1 for h, _ in keys})

    def open(self) -> OpenArray:
        return OpenArray(self.packed, self.n, self.path_sizes, self.host_labels)

    def sent(self, spark: SparkSession) -> tuple[str, int, tuple, tuple]:
        """Hand the array to Spark as a file, which each machine of an executor gets once; its name and measures."""
        folder = tempfile.mkdtemp(prefix="urls-")  # the driver's own; executors fetch the file from the driver
        name = f"urls-{uuid.uuid4().hex}.bin"
        with open(os.path.join(folder, name), "wb") as f:
            f.write(self.packed or b"\0")
        spark.sparkContext.addFile(os.path.join(folder, name))
        return name, self.n, tuple(self.path_sizes), tuple(self.host_labels)


class OpenArray:
    """The array over bytes or a mapped file, whose pages all workers of a machine share."""

    def __init__(self, data: bytes | mmap.mmap, n: int, path_sizes: Iterable[int], host_labels: Iterable[int]):
        self.path_sizes, self.host_labels, at = list(path_sizes), list(host_labels), 0

        def part(kind: type, count: int) -> np.ndarray:
            nonlocal at
            made = np.frombuffer(data, kind, count, at)
            at += made.nbytes
            return made

        self.digests, self.ends, self.host_size, self.allows = part(np.uint64, n), part(np.int64, n + 1 if n else 0), part(np.int32, n), part(np.uint8, n)
        self.strings, self.first = data, at

    def text(self, k: int) -> bytes:
        return self.strings[self.first + int(self.ends[k]) : self.first + int(self.ends[k + 1])]

    def candidates(self, host: str, path: str) -> list[str]:
        """Every rule text that could fit: suffixes of the host at its dots, times beginnings of the path."""
        labels = host.split(".")
        ends = [".".join(labels[-k:]) for k in self.host_labels if k <= len(labels)]
        starts = [path[:k] for k in self.path_sizes if k <= len(path)]
        return [e + s for e in ends for s in starts]

    def longest(self, urls: list[tuple[str, str]]) -> list[int]:
        """For each (host, path) the number of its longest rule, or -1; equal lengths: the longer host."""
        asked = [self.candidates(h, p) for h, p in urls]
        flat = [c.encode("utf-8", "replace") for a in asked for c in a]
        owner = np.repeat(np.arange(len(urls)), [len(a) for a in asked])
        best = [-1] * len(urls)
        if not flat or not len(self.digests):
            return best
        probe = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, len(flat))
        at = np.searchsorted(self.digests, probe)
        hit = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == probe)
        for i in hit.tolist():
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == probe[i]:  # more than one text may share a digest
                if self.text(k) == flat[i]:
                    o = int(owner[i])
                    host, path = urls[o]
                    # The text was cut from another place of the url than the rule's own border
                    # where host and path lengths differ; only the rule's own split counts.
                    size = int(self.host_size[k])
                    rule = flat[i].decode()
                    if (host == rule[:size] or host.endswith("." + rule[:size])) and path.startswith(rule[size:]) and (best[o] < 0 or self._rank(k) > self._rank(best[o])):
                        best[o] = k
                k += 1
        return best

    def _rank(self, k: int) -> tuple[int, int]:
        return int(self.ends[k + 1] - self.ends[k]), int(self.host_size[k])



@lru_cache(maxsize=8)
def _opened(name: str, n: int, sizes: tuple, labels: tuple) -> OpenArray:
    with open(SparkFiles.get(name), "rb") as f:
        return OpenArray(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), n, sizes, labels)


Rules = Iterable[tuple[str, str, str]] | DataFrame


def read_list(spark: SparkSession, path: str, verdict: str = "block") -> DataFrame:
    """Columns verdict, host and path from a text file of one entry a line: a host, or a host and a path.

    Lines are trimmed; empty ones and those that begin with # are passed over. The file may lie
    wherever Spark reads.
    """
    line = F.trim("value")
    entry = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(line.alias("entry"))
    host = F.regexp_extract("entry", "^[^/]*", 0)
    return entry.select(F.lit(verdict).alias("verdict"), host.alias("host"), F.expr("substring(entry, length(regexp_extract(entry, '^[^/]*', 0)) + 1)").alias("path")).distinct()


def judge_urls(pages: DataFrame, url: str = "url", rules: Rules = RULES, listed: Rules = LISTED, how: UrlFilter = UrlFilter(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns `row`, host, path, rule, verdict, listed.

    The longest rule that fits gives the verdict; where none fits, the longest listed entry does,
    and everything else is allowed. A rule fits its host and all subdomains if the path starts
    with the rule's. Rules and entries are tuples or frames of verdict, host and path; those
    beyond the bounds of `how` are joined. Null urls and those without :// have an empty host and
    path and are allowed. Repeated rows are judged alike; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    if any(_too_large(x, how) for x in (rules, listed)):
        return judge_urls_by_join(pages, _frame(spark, rules), url, keep, _frame(spark, listed))
    arrays = [DigestArray(x if not isinstance(x, DataFrame) else map(tuple, x.select("verdict", "host", "path").collect())) for x in (rules, listed)]
    sent = [a.sent(spark) for a in arrays]

    def of(batch: pa.RecordBatch) -> list:
        by_rule, by_list = (_opened(*a) for a in sent)
        parts = [split_url(u) for u in batch.column(1).to_pylist()]
        out: list[list] = [[], [], [], [], []]
        for (host, path), r, e in zip(parts, by_rule.longest(parts), by_list.longest(parts), strict=True):
            array, k = (by_rule, r) if r >= 0 else (by_list, e)
            verdict = "allow" if k < 0 or array.allows[k] else "block"
            for o, v in zip(out, (host, path, by_rule.text(r).decode() if r >= 0 else None, verdict, by_list.text(e).decode() if e >= 0 else None), strict=True):
                o.append(v)
        return [batch.column(0), *out]

    rows = as_row(pages, keep, F.col(url).cast("string").alias("url"))
    return map_batches(rows, of, T.StructType([rows.schema["row"], *fields("host string, path string, rule string, verdict string, listed string").fields]), text=1)


def _frame(spark: SparkSession, rules: Rules) -> DataFrame:
    return rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _too_large(rules: Rules, how: UrlFilter) -> bool:
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        return len(rules) > how.max_rules or sum(len(h) + len(p) + 21 for _, h, p in rules) > how.max_bytes
    n, size = rules.agg(F.count(F.lit(1)), F.sum(F.octet_length("host") + F.octet_length("path") + 21)).first()
    return n > how.max_rules or (size or 0) > how.max_bytes


def judge_urls_by_join(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] | None = None, listed: DataFrame | None = None) -> DataFrame:
    """The rows of judge_urls, for lists of any size.

    Each url meets, by an equi-join on the rule's text, the suffixes of its host times the
    beginnings of its path of the lengths that rules have. Only texts that are both asked for and
    listed meet the urls; a suffix that most urls share is one row until then. A rule of both verdicts allows.
    """
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1)
    host, path = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    rows = as_row(pages, keep, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    places = settle(rows.select("host", "path").distinct())

    def best(of: DataFrame, name: str) -> DataFrame:
        keyed = of.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        keyed = keyed.groupBy("rule_host", "rule_path").agg(F.when(F.bool_or(F.col("verdict") == "allow"), "allow").otherwise("block").alias("verdict"))
        sizes = [r[0] for r in keyed.select(F.length("rule_path")).distinct().collect()]  # a few numbers, however long the list
        labels = F.split("host", r"\.")
        ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))
        starts = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in sizes] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
        asked = places.select("host", "path", F.explode(ends).alias("rule_host"), starts.alias("starts")).select("host", "path", "rule_host", F.explode("starts").alias("rule_path"))
        met = settle(asked.select("rule_host", "rule_path").distinct().join(keyed, ["rule_host", "rule_path"]))
        rule = F.concat("rule_host", "rule_path")
        longest = F.max(F.struct(F.octet_length(rule), F.length("rule_host"), rule.alias("rule"), "verdict"))
        return asked.join(met, ["rule_host", "rule_path"]).groupBy("host", "path").agg(longest.alias(name))

    found = rows.join(best(rules, "by_rule"), ["host", "path"], "left")
    found = found.join(best(listed, "by_list"), ["host", "path"], "left") if listed is not None else found.withColumn("by_list", F.lit(None).cast("struct<rule: string, verdict: string>"))
    return found.select("row", "host", "path", "by_rule.rule", F.coalesce("by_rule.verdict", "by_list.verdict", F.lit("allow")).alias("verdict"), F.col("by_list.rule").alias("listed"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), keep=("page_id",)).select("row.page_id", "host", "path", "rule", "verdict", "listed")


def _rules_sql() -> str:
    return ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


def op7_oracle() -> str:
    names = ", ".join(f"('{h}')" for _, h, _ in LISTED)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, h, p) AS (VALUES {_rules_sql()}), listed(h) AS (VALUES {names}),
fit AS (SELECT page_id, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC) AS k
        FROM parts JOIN rules r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)),
hit AS (SELECT page_id, max(l.h) AS listed FROM parts JOIN listed l ON host = l.h OR ends_with(host, '.' || l.h) GROUP BY page_id)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, listed
FROM parts LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (page_id) LEFT JOIN hit USING (page_id)"""
