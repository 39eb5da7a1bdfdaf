"""Usage buckets kept up to date while requests arrive in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logloom.operators.usage import MEASURES, usage_buckets

KEYS = ("session", "kind", "model", "provider", "time")
COUNTS = ("requests", "measured", *MEASURES)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files under a path, each read once and whole."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def follow_buckets(requests: DataFrame, into: str, state: str, every: str | None = None) -> StreamingQuery:
    """Write the buckets that each batch changes, with their new sums, to a folder of the batch's number.

    Requests may be late by any time and still correct their bucket, so there is no watermark; the
    state is one row per bucket. A batch that is repeated after a failure overwrites its own folder,
    so nothing counts twice. every: the trigger's interval; None works off what is there and ends.
    An empty stream leaves an empty table.
    """
    buckets = usage_buckets(requests)
    spark = requests.sparkSession
    spark.createDataFrame([], buckets.schema).write.mode("overwrite").parquet(f"{into}/batch=-1")

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{into}/batch={batch}")

    out = buckets.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(write)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def followed_buckets(spark: SparkSession, into: str) -> DataFrame:
    """The buckets as the last batch that changed each has left them."""
    changes = spark.read.parquet(into)
    return changes.groupBy(*KEYS).agg(F.max_by(F.struct(*COUNTS), "batch").alias("last")).select(*KEYS, "last.*")
