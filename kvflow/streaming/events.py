"""Unbounded inputs (an extension: the batch queries on a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def windowed_counts(events: DataFrame, key: str, time: str = "ts", window: str = "1 day", late: str | None = "1 day") -> DataFrame:
    """(window_start, key, n): tumbling windows; with ``late`` a watermark bounds the state of a stream."""
    source = events.withWatermark(time, late) if late and events.isStreaming else events
    counted = source.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), key, "n")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is there and stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
