"""Cost of requests: price rules, peak windows, sums by route and session.

Frames of bills have session, provider, model, t_ms and the counters cache_read, uncached,
cache_write, cache_write_1h and output. Price lists are small tables: a join sends them to every
task while they lie under the session's broadcast threshold, and shuffles beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.sources.shared import settle

COUNTERS = ("cache_read", "uncached", "cache_write", "cache_write_1h", "output")
#: Local hours of peak prices, from and before, on working days.
PEAK = ((9, 12), (14, 18))
#: Yuan for a dollar, inverse.
CNY = 0.15


def price_rules(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Columns rule, hit, miss, write, write_1h, out: prices of a million tokens."""
    return spark.createDataFrame(rows, "rule string, hit double, miss double, write double, write_1h double, out double")


def in_peak(t_ms: Column, windows: tuple = PEAK) -> Column:
    """Whether a time lies in a peak window, from its first hour to before its last, Monday to Friday."""
    at = F.timestamp_millis(t_ms)
    hour, working = F.hour(at), F.dayofweek(at).between(2, 6)
    inside = F.lit(False)
    for a, b in windows:
        inside = inside | ((hour >= a) & (hour < b))
    return working & inside


def matched_rules(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """The price rule of each (provider, model): that of both, of the provider, or of the model alone.

    Without a provider only the model's own rule counts.
    """
    out = pairs
    named = F.col("provider") != ""
    keys = (("exact", F.when(named, F.concat("provider", F.lit("/"), "model"))), ("wide", F.when(named, F.concat("provider", F.lit("/*")))), ("bare", F.col("model")))
    for name, key in keys:
        r = rules.select(F.col("rule").alias(f"{name}_rule"), F.struct(*[c for c in rules.columns]).alias(name))
        out = out.withColumn(f"{name}_key", key).join(r, F.col(f"{name}_key") == F.col(f"{name}_rule"), "left").drop(f"{name}_key", f"{name}_rule")
    return out.withColumn("price", F.coalesce("exact", "wide", "bare")).drop("exact", "wide", "bare")


def resolved_prices(models: DataFrame, registry: DataFrame) -> DataFrame:
    """Each model's registry entry: the same name, else the only one equal without case, else none."""
    exact = registry.select(F.col("name").alias("same"), F.col("name").alias("exact"))
    loose = registry.groupBy(F.lower("name").alias("low")).agg(F.when(F.count(F.lit(1)) == 1, F.min("name")).alias("loose"))
    return models.join(exact, F.col("model") == F.col("same"), "left").join(loose, F.lower("model") == F.col("low"), "left").select("model", F.coalesce("exact", "loose").alias("entry"))


def cost_buckets(bills: DataFrame) -> DataFrame:
    """Counters summed by route and by whether the time lay in a peak window."""
    return bills.groupBy("provider", "model", in_peak(F.col("t_ms")).alias("peak")).agg(F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in COUNTERS])


def peak_schedules(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Columns rule, zone, working_only, windows (minutes of the day, from and before) and off, the share of the price outside of them."""
    return spark.createDataFrame(rows, "rule string, zone string, working_only boolean, windows array<struct<from:int,before:int>>, off double")


def scheduled_peak(t_ms: Column, zone: Column, working_only: Column, windows: Column) -> Column:
    """Whether a time lies in a window of its schedule, by the clock of the schedule's zone."""
    at = F.from_utc_timestamp(F.to_utc_timestamp(F.timestamp_millis(t_ms), F.current_timezone()), zone)
    minute, working = F.hour(at) * 60 + F.minute(at), F.dayofweek(at).between(2, 6)
    return (~working_only | working) & F.exists(windows, lambda w: (minute >= w["from"]) & (minute < w["before"]))


def priced_routes(bills: DataFrame, rules: DataFrame, schedules: DataFrame) -> DataFrame:
    """The price and the schedule of each route of the bills; routes are few, so that bills are joined once."""
    routes = matched_rules(bills.select("provider", "model").distinct(), rules)
    own = schedules.select(F.col("rule").alias("of"), F.struct("zone", "working_only", "windows", "off").alias("schedule"))
    return settle(routes.join(own, F.col("price.rule") == F.col("of"), "left").select("provider", "model", "price", "schedule"))


def nano_dollars() -> Column:
    """A request's cost in whole thousand-millionths of a dollar, so that sums do not depend on their order."""
    p = lambda k: F.col(f"price.{k}")
    long_write = F.least("cache_write_1h", "cache_write")
    cost = F.col("cache_read") * p("hit") + F.col("uncached") * p("miss") + (F.col("cache_write") - long_write) * p("write") + long_write * p("write_1h") + F.col("output") * p("out")
    peak = scheduled_peak(F.col("t_ms"), F.col("schedule.zone"), F.col("schedule.working_only"), F.col("schedule.windows"))
    return F.round(cost * 1000 * F.when(F.col("schedule").isNull() | peak, 1.0).otherwise(F.col("schedule.off"))).cast("bigint")


def session_costs(bills: DataFrame, rules: DataFrame, schedules: DataFrame) -> DataFrame:
    """Dollars and yuan of each session; null if none of its requests has a price. And dollars a request.

    Outside the windows of its rule's schedule a request costs the share `off`; a rule without a
    schedule has one price.
    """
    priced = bills.join(priced_routes(bills, rules, schedules), ["provider", "model"], "left")
    usd = priced.groupBy("session").agg((F.sum(nano_dollars()) / 1e9).alias("usd"), F.count(F.lit(1)).alias("requests"))
    return usd.select("session", "usd", (F.col("usd") / CNY).alias("cny"), (F.col("usd") / F.col("requests")).alias("usd_each"))


def family_costs(bills: DataFrame, members: DataFrame) -> DataFrame:
    """Counters summed over each root session and those under it."""
    return bills.join(members, "session").groupBy("root", "provider").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def unpriced(bills: DataFrame, rules: DataFrame) -> DataFrame:
    """Routes without a price. Routes are made distinct first: they are few."""
    pairs = bills.select("provider", "model").distinct()
    return matched_rules(pairs, rules).where(F.col("price").isNull()).select("provider", "model")
