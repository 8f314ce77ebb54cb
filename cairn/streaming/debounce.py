"""File events: quiet periods in batch, and a stream that hands on the last event of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUIET = "10 minutes"


def sessions(events: DataFrame, quiet: str = QUIET) -> DataFrame:
    """One row per path and burst of events that are less than `quiet` apart: the last operation counts."""
    rows = events.select(F.col("user_id").alias("path"), F.col("event_type").alias("op"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    grouped = rows.groupBy("path", F.session_window("at", quiet).alias("s"))
    return grouped.agg(F.count("*").alias("events"), F.max("at").alias("last_at"), F.max_by("op", F.struct("at", "event_id")).alias("op")).drop("s")


def stream_sessions(spark: SparkSession, folder: str, schema, quiet: str = QUIET, late: str = "1 hour") -> DataFrame:
    """The same over a growing folder of event files; bursts come out once the watermark has passed them."""
    events = spark.readStream.schema(schema).parquet(folder)
    rows = events.select(F.col("user_id").alias("path"), F.col("event_type").alias("op"), F.col("ts").cast("timestamp").alias("at"), "event_id").withWatermark("at", late)
    return rows.groupBy("path", F.session_window("at", quiet).alias("s")).agg(F.count("*").alias("events"), F.max("at").alias("last_at"), F.max_by("op", F.struct("at", "event_id")).alias("op")).drop("s")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Work off what is there, write it as Parquet, and stop."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
