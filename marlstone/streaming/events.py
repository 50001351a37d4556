"""An event-time extension: the reference has no streams; these aggregates run over static and streaming tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and totals of each window and type; ``late`` is how long a stream waits for late events."""
    if late is not None:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """One row for each user's session: events no more than the gap apart."""
    if late is not None:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files as they arrive."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder)
