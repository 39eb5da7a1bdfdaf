"""Log-shaped views over the star-schema tables: what a decoder would make of real transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The day that stands for today in every query; wall clocks are never read.
TODAY = "2024-01-30"
#: 2024-01-30 00:00 UTC in epoch milliseconds.
NOW_MS = 1706572800000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Whole milliseconds since the epoch of a time without zone, cut and not rounded."""
    return F.floor((F.unix_micros(ts.cast("timestamp"))) / 1000).cast("bigint")


def long(c: Column) -> Column:
    return c.cast("bigint")


def _fields(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", "event_type", "value", epoch_ms(F.col("ts")).alias("t_ms"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(table(spark, sf_dir, "events"))


def requests_of(events: DataFrame) -> DataFrame:
    """Model requests: one row of each event, with null counters where nothing was measured."""
    k = F.col("k")
    measured = k % 7 != 0
    only = lambda c: F.when(measured, c)
    return _fields(events).select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("session"), F.col("event_type").alias("kind"), F.concat(F.lit("m"), (k % 5).cast("string")).alias("model"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("provider"),
        "t_ms", "k", measured.alias("measured"), only(k * 10).alias("input"), only(F.floor(F.col("value") * 10)).alias("output"), only(k * 3).alias("cache_read"), only(k % 4).alias("cache_write"), only(k % 5).alias("reasoning"),
    )


def usage_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(table(spark, sf_dir, "events"))


def on_few_routes(requests: DataFrame) -> DataFrame:
    """The same requests under two sessions and two routes, so that quarter-hours fill up."""
    k = F.col("k")
    return requests.withColumns({"session": F.col("session") % 2, "kind": F.lit("agent"), "model": F.concat(F.lit("m"), (k % 2).cast("string")), "provider": F.concat(F.lit(" P"), (k % 2).cast("string"))})


def bucket_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_few_routes(usage_view(spark, sf_dir))


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool results and boundaries of each user, in order of seq."""
    return _events(spark, sf_dir).select(
        F.col("user_id").alias("file"), F.col("event_id").alias("seq"), "t_ms", "k", "value", "event_type", (F.col("event_type") == "signup").alias("boundary"),
        F.col("event_type").isin("error", "click", "view").alias("is_error"), F.concat(F.lit("t"), (F.col("k") % 2).cast("string")).alias("tool"),
    )


def span_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of time on lanes."""
    return _events(spark, sf_dir).select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), F.col("event_type").alias("lane"), F.col("t_ms").alias("start"), (F.col("t_ms") + F.floor(F.col("value") * 60000)).alias("end"), "k")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, as the producers of these logs count it."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def message_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of conversations; assistant messages stand for model requests."""
    tokens = F.ceil(utf16_length(F.col("text")) / 4) + 8
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("seq"), F.col("role").alias("cat"), "text", tokens.alias("tokens"))


def turn_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the number of their turn, which a user's message opens, and of their step."""
    w = Window.partitionBy("file").orderBy("seq")
    return (
        message_view(spark, sf_dir).withColumn("turn", long(F.sum(F.when(F.col("cat") == "user", 1).otherwise(0)).over(w)))
        .withColumn("step", long(F.sum(F.when(F.col("cat") == "assistant", 1).otherwise(0)).over(Window.partitionBy("file", "turn").orderBy("seq"))))
    )


def document_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("session"), F.col("lang").alias("file"), F.col("doc_id").alias("line"), "text")


def page_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/$", "")
    return table(spark, sf_dir, "pages").select("page_id", "url", "html", path.alias("path"))


def tree_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents of three levels: regions, their nations, and customers of these."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"), F.lit(0).cast("bigint").alias("weight"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name", F.lit(0).cast("bigint"))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "c_name", F.floor("c_acctbal").cast("bigint"))
    return region.union(nation).union(customer)


def bill_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billed requests: model of a part's brand, provider of a supplier's nation."""
    line, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    return (
        line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("l_orderkey").alias("session"), F.col("n_name").alias("provider"), F.col("p_brand").alias("model"), (epoch_ms(F.col("l_shipdate")) + (F.col("l_orderkey") % 24) * 3600000).alias("t_ms"),
            long(F.col("l_quantity")).alias("cache_read"), F.floor(F.col("l_extendedprice") / 100).cast("bigint").alias("uncached"), long(F.col("l_linenumber")).alias("cache_write"), (F.col("l_orderkey") % 3).alias("cache_write_1h"), long(F.col("l_quantity") * 2).alias("output"),
        )
    )


#: The same views as common table expressions for DuckDB.
SQL = {
    "ev": "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS t_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)",
    "v_usage": """v_usage AS (SELECT event_id AS seq, user_id AS session, event_type AS kind, 'm' || CAST(k % 5 AS VARCHAR) AS model, 'p' || CAST(k % 3 AS VARCHAR) AS provider, t_ms, k, k % 7 <> 0 AS measured,
 CASE WHEN k % 7 <> 0 THEN k * 10 END AS input, CASE WHEN k % 7 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS output, CASE WHEN k % 7 <> 0 THEN k * 3 END AS cache_read, CASE WHEN k % 7 <> 0 THEN k % 4 END AS cache_write, CASE WHEN k % 7 <> 0 THEN k % 5 END AS reasoning FROM ev)""",
    "v_bucket": "v_bucket AS (SELECT * REPLACE (session % 2 AS session, 'agent' AS kind, 'm' || CAST(k % 2 AS VARCHAR) AS model, ' P' || CAST(k % 2 AS VARCHAR) AS provider) FROM v_usage)",
    "v_log": "v_log AS (SELECT user_id AS file, event_id AS seq, t_ms, k, value, event_type, event_type = 'signup' AS boundary, event_type IN ('error', 'click', 'view') AS is_error, 't' || CAST(k % 2 AS VARCHAR) AS tool FROM ev)",
    "v_span": "v_span AS (SELECT user_id AS file, event_id AS seq, event_type AS lane, t_ms AS start, t_ms + CAST(floor(value * 60000) AS BIGINT) AS \"end\", k FROM ev)",
    "v_msg": "v_msg AS (SELECT conv_id AS file, turn AS seq, role AS cat, text, CAST(ceil((length(text) + length(regexp_replace(text, '[\\x{0000}-\\x{FFFF}]', '', 'g'))) / 4.0) AS BIGINT) + 8 AS tokens FROM conversations)",
    "v_turn": """v_turn0 AS (SELECT *, CAST(sum(CASE WHEN cat = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY seq) AS BIGINT) AS turn FROM v_msg),
v_turn AS (SELECT *, CAST(sum(CASE WHEN cat = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY file, turn ORDER BY seq) AS BIGINT) AS step FROM v_turn0)""",
    "v_doc": "v_doc AS (SELECT source AS session, lang AS file, doc_id AS line, text FROM documents)",
    "v_page": "v_page AS (SELECT page_id, url, html, regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/$', '') AS path FROM pages)",
    "v_tree": """v_tree AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS label, CAST(0 AS BIGINT) AS weight FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 0 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, CAST(floor(c_acctbal) AS BIGINT) FROM customer)""",
    "v_bill": """v_bill AS (SELECT l_orderkey AS session, n_name AS provider, p_brand AS model, epoch_us(l_shipdate) // 1000 + (l_orderkey % 24) * 3600000 AS t_ms, CAST(l_quantity AS BIGINT) AS cache_read, CAST(floor(l_extendedprice / 100) AS BIGINT) AS uncached,
 CAST(l_linenumber AS BIGINT) AS cache_write, l_orderkey % 3 AS cache_write_1h, CAST(l_quantity * 2 AS BIGINT) AS output
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)""",
}
_NEEDS = {"v_usage": ("ev",), "v_bucket": ("ev", "v_usage"), "v_log": ("ev",), "v_span": ("ev",), "v_turn": ("v_msg",)}


def with_views(*names: str) -> str:
    """WITH and the named views, what they build on first."""
    out: list[str] = []
    for n in names:
        out += [x for x in (*_NEEDS.get(n, ()), n) if x not in out]
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in out)
