"""Running sums over keys of any size: no key has to fit in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.sources.shared import settle


def running_sums(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], before: bool = False) -> DataFrame:
    """All columns and, for each of sums, its running sum within a key in the order given.

    before: leave the row itself out. keys and order name columns of rows and together tell rows apart. Rows are dealt by ranges of
    keys and order, so a key of many rows spans several tasks; each task sums its own part, and what
    lies before the part is added from one row per key and task. A null value counts as zero.
    """
    tagged = rows.withColumns({f"_v{k}": F.coalesce(c, F.lit(0)).cast("bigint") for k, c in enumerate(sums.values())})
    parts = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = settle(tagged.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    values = [f"_v{k}" for k in range(len(sums))]
    carried = dealt.groupBy("_part", *keys).agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(F.col("_part").alias("_at"), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_c{k}") for k, v in enumerate(values)])
    own = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    summed = dealt.withColumns({f"_s{k}": F.coalesce(F.sum(v).over(own), F.lit(0)) for k, v in enumerate(values)})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)), F.col("_part") == F.col("_at"))
    return summed.join(carried, same).select(*rows.columns, *[(F.col(f"_s{k}") + F.col(f"_c{k}")).alias(name) for k, name in enumerate(sums)])
