"""Structured Streaming over batches of price snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(rows: DataFrame, delay: str = "20 days") -> DataFrame:
    """Each snapshot once; what state remembers is bounded by the delay."""
    return rows.withWatermark("recorded_at", delay).dropDuplicatesWithinWatermark(["market_id", "outcome_index", "recorded_at"])


def hourly_last(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Last value of each outcome in each hour; also runs on a batch."""
    last = F.max_by("value", F.struct("recorded_at", "event_id"))
    grouped = rows.withWatermark("recorded_at", delay).groupBy(F.window("recorded_at", "1 hour").alias("w"), "market_id", "outcome_index")
    return grouped.agg(last.alias("last_value"), F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "market_id", "outcome_index", "last_value", "n")


def append_to(rows: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends what has arrived to a table, one folder a day, and then stops."""
    out = rows.withColumn("day", F.to_date("recorded_at"))
    return out.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
