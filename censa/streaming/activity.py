"""Streams over the activity log. An extension: the workflow itself only has an append-only log and an in-memory bus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_log(spark: SparkSession, path: str, schema: str = SCHEMA, fmt: str = "parquet", files: int = 100) -> DataFrame:
    """The log as a stream of new files."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def windowed_counts(log: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events and value by kind and window; events later than the watermark are left out. Works on a batch as well."""
    marked = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: runs of events without a gap."""
    marked = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def fan_out(log: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None]):
    """Each micro-batch to every sink, once for each batch id that a sink keeps; the batch is computed once."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
