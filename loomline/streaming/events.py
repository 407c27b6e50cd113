"""Structured Streaming forms of the event tables; an extension, the batch operators don't need them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def transaction_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of (user_id, item_id, ts, price, channel) as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_quantities(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """(user_id, item_id, date, quantity) by event-time day; rows later than the watermark are dropped by the engine."""
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id", "item_id").agg(F.count(F.lit(1)).alias("quantity"))
    return counted.select("user_id", "item_id", F.col("window.start").cast("date").alias("date"), "quantity")


def distinct_purchases(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """First row of each user, item and day within the watermark."""
    return stream.withColumn("date", F.to_date("ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "item_id", "date"])


def sliding_popularity(stream: DataFrame, weeks: int = 1, late: str = "2 days") -> DataFrame:
    """(start, end, item_id, n) of windows of ``weeks`` weeks that slide by a day."""
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", f"{7 * weeks} days", "1 day"), "item_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "item_id", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of bursts of activity."""
    counted = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
