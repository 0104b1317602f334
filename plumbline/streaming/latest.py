"""Latest value per series and windowed counts over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_per_series(events: DataFrame, series: str, at: str, value: str) -> DataFrame:
    """Newest value of each series; on a stream use the update or complete mode. Works on batches too."""
    return events.groupBy(series).agg(F.max(F.struct(at, value)).alias("s")).select(series, F.col(f"s.{at}").alias(at), F.col(f"s.{value}").alias(value))


def windowed(events: DataFrame, at: str, key: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and sum by key and tumbling window; events later than `late` after the watermark are dropped on a stream."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp"))
    stamped = stamped.withWatermark(at, late) if events.isStreaming else stamped
    out = stamped.groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,6)")).cast("double").alias("total"))
    return out.select(F.col("w.start").alias("from_ts"), key, "n", "total")


def distinct_events(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """First arrival of each key; on a stream, keys are remembered until the watermark passes."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp"))
    return stamped.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else stamped.dropDuplicates([key])


def to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream once through all available data; restartable from its checkpoint."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(folder)
