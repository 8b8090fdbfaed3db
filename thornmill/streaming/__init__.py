"""Windows over a stream of events; the same functions serve tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A folder of Parquet files, each taken up when it appears."""
    return spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts for each window and key; rows later than the watermark are left out of a stream."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark(time, late)
    return stamped.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts for each run of a key's events without a pause as long as ``gap``."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark(time, late)
    return stamped.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), *keys, "n")
