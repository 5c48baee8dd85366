"""Streaming forms; the batch engine has no counterpart of these, they are additions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text


def ingest_stream(rows: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Cleaned texts of over five characters, each once within the watermark."""
    kept = rows.withColumn("text", clean_text("text")).where(F.length("text") > 5)
    return kept.withWatermark(time, delay).dropDuplicatesWithinWatermark(["text"])


def event_counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events and their value per type and tumbling window; late ones beyond the delay are dropped."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "value")
