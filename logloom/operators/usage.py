"""Token usage: buckets, filters, rankings and calendars over model requests.

Frames of requests have session, kind, model, provider, t_ms and the counters input, output,
cache_read, cache_write, reasoning, which are null where nothing was measured. Frames of buckets
are what `usage_buckets` returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTER_HOUR = 900_000
MEASURES = ("input", "output", "cache_read", "cache_write", "reasoning", "total")
#: The lifetime totals that count as milestones.
MILESTONES = (10**6, 10**7, 10**8, 10**9, 5 * 10**9, 10**10, 10**11, 10**12)


def request_measures() -> dict[str, Column]:
    """Per request: what the input shows with caches in it, and the total; null if unmeasured."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    shown = zero("input") + zero("cache_read") + zero("cache_write")
    return {"input": shown, "output": zero("output"), "cache_read": zero("cache_read"), "cache_write": zero("cache_write"), "reasoning": zero("reasoning"), "total": shown + zero("output")}


def bucket_time(t_ms: Column) -> Column:
    """Start of the quarter-hour; null for missing, zero and negative times."""
    return F.when(t_ms > 0, t_ms - F.pmod(t_ms, F.lit(QUARTER_HOUR)))


def usage_buckets(requests: DataFrame) -> DataFrame:
    """One row per session, kind, route and quarter-hour: requests, how many were measured, sums.

    Missing usage counts as a request but not as zeros: `measured` says how many rows the sums
    rest on. Providers are trimmed and lower-cased; missing route names are named as unknown.
    """
    m = request_measures()
    model = F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("Unknown model"))
    provider = F.coalesce(F.nullif(F.lower(F.trim("provider")), F.lit("")), F.lit("Unknown provider"))
    own = F.col("measured")
    return (
        requests.select("session", "kind", model.alias("model"), provider.alias("provider"), bucket_time(F.col("t_ms")).alias("time"), own, *[F.when(own, c).alias(k) for k, c in m.items()])
        .groupBy("session", "kind", "model", "provider", "time")
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if(own).alias("measured"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in MEASURES])
    )


def day_of(time: Column) -> Column:
    return F.date_format(F.timestamp_millis(time), "yyyy-MM-dd")


def filter_usage(buckets: DataFrame, start: str = "", end: str = "", kind: str = "", model: str = "", provider: str = "", query: str = "") -> DataFrame:
    """Inclusive days, equal names, and a text that kind, model, provider and session contain together.

    Buckets without a time pass only where no day is asked for.
    """
    out = buckets
    for name, want in (("kind", kind), ("model", model), ("provider", provider)):
        if want:
            out = out.where(F.col(name) == want)
    if query.strip():
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "kind", "model", "provider", F.col("session").cast("string"))), F.lit(query.strip().lower())))
    if start:
        out = out.where(day_of(F.col("time")) >= start)
    if end:
        out = out.where(day_of(F.col("time")) <= end)
    return out


def usage_totals(buckets: DataFrame) -> DataFrame:
    return buckets.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("requests", "measured", *MEASURES)], F.count_distinct("session").alias("sessions"))


def rank_usage(buckets: DataFrame, key: str, top: int = 8) -> DataFrame:
    """The keys of the greatest totals, equal ones by name, with each one's share of all."""
    sums = buckets.groupBy(F.col(key).cast("string").alias("key")).agg(F.sum("total").alias("total"))
    every = sums.agg(F.sum("total").alias("every"))
    return sums.crossJoin(F.broadcast(every)).orderBy(F.desc("total"), "key").limit(top).select("key", "total", F.round(F.col("total") / F.col("every"), 6).alias("share"))


def daily(buckets: DataFrame) -> DataFrame:
    return buckets.where(F.col("time").isNotNull()).groupBy(day_of(F.col("time")).alias("day")).agg(F.sum("total").alias("total"))


def daily_summary(buckets: DataFrame) -> DataFrame:
    """Days with totals, whether each is the peak (the earliest of equal ones), and the active days' number."""
    w = Window.partitionBy()
    d = daily(buckets)
    peak = F.max_by("day", F.struct("total", -F.datediff("day", F.lit("1970-01-01")))).over(w)
    return d.select("day", "total", (F.col("day") == peak).alias("is_peak"), F.count_if(F.col("total") > 0).over(w).alias("active_days"))


def by_hour(buckets: DataFrame) -> DataFrame:
    """Totals of the 24 hours of the day, hours without any as zero."""
    hours = buckets.sparkSession.range(24).select(F.col("id").alias("hour"))
    got = buckets.where(F.col("time").isNotNull()).groupBy(F.hour(F.timestamp_millis("time")).cast("bigint").alias("hour")).agg(F.sum("total").alias("total"))
    return hours.join(got, "hour", "left").select("hour", F.coalesce("total", F.lit(0)).alias("total"))


def by_weekday(buckets: DataFrame) -> DataFrame:
    """Totals of the weekdays, Sunday as 0, days without any as zero."""
    days = buckets.sparkSession.range(7).select(F.col("id").alias("weekday"))
    got = buckets.where(F.col("time").isNotNull()).groupBy((F.dayofweek(F.timestamp_millis("time")) - 1).cast("bigint").alias("weekday")).agg(F.sum("total").alias("total"))
    return days.join(got, "weekday", "left").select("weekday", F.coalesce("total", F.lit(0)).alias("total"))


def heatmap(buckets: DataFrame, today: str) -> DataFrame:
    """The days of 53 weeks up to today's, each with a level of 0 to 4 by the root of its share of the greatest."""
    end = F.lit(today).cast("date")
    spine = buckets.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, F.lit(364) + F.dayofweek(end) - 1), end)).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    filled = spine.join(daily(buckets), "day", "left").select("day", F.coalesce("total", F.lit(0)).alias("total"))
    most = F.greatest(F.lit(1), F.max("total").over(Window.partitionBy()))
    return filled.select("day", "total", F.ceil(F.sqrt(F.col("total") / most) * 4).alias("level"))


def strided_trend(buckets: DataFrame, bars: int = 90) -> DataFrame:
    """At most so many bars: days in order, summed in runs of equal length."""
    w = Window.partitionBy()
    numbered = daily(buckets).withColumn("i", F.row_number().over(Window.orderBy("day")) - 1).withColumn("stride", F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(w) / bars)))
    return numbered.groupBy(F.floor(F.col("i") / F.col("stride")).alias("bar")).agg(F.min("day").alias("day"), F.sum("total").alias("value"))


def period_delta(buckets: DataFrame, start: str, end: str) -> DataFrame:
    """The total of a period, of the period before of the same length, and the change in percent."""
    day, first, last = day_of(F.col("time")).cast("date"), F.lit(start).cast("date"), F.lit(end).cast("date")
    length = F.datediff(last, first) + 1
    now, before = F.when((day >= first) & (day <= last), F.col("total")), F.when((day >= F.date_sub(first, length)) & (day < first), F.col("total"))
    sums = buckets.agg(F.coalesce(F.sum(now), F.lit(0)).alias("total"), F.coalesce(F.sum(before), F.lit(0)).alias("previous"))
    return sums.withColumn("change", F.when(F.col("previous") > 0, F.round((F.col("total") / F.col("previous") - 1) * 100, 6)))


def milestone(buckets: DataFrame) -> DataFrame:
    """The lifetime total and the next milestone above it, null beyond the last."""
    marks = F.array(*[F.lit(m).cast("bigint") for m in MILESTONES])
    return buckets.agg(F.sum("total").alias("lifetime")).select("lifetime", F.try_element_at(F.filter(marks, lambda m: m > F.col("lifetime")), F.lit(1)).alias("next"))


def streak(buckets: DataFrame, today: str) -> DataFrame:
    """Longest run of days with tokens, and the run that ends today or else yesterday."""
    days = daily(buckets).where(F.col("total") > 0).select(F.col("day").cast("date").alias("d"))
    island = F.date_sub("d", F.row_number().over(Window.orderBy("d")))
    runs = days.withColumn("island", island).groupBy("island").agg(F.count(F.lit(1)).alias("run"), F.max("d").alias("last"))
    now = F.lit(today).cast("date")
    return runs.agg(F.coalesce(F.max(F.when(F.col("last") == now, F.col("run"))), F.max(F.when(F.col("last") == F.date_sub(now, 1), F.col("run"))), F.lit(0)).alias("current"), F.coalesce(F.max("run"), F.lit(0)).alias("longest"))
