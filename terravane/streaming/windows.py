"""Structured Streaming over event tables: windowed counts with late data, and sessions.

State is bounded by the watermark, and results go to files in the shared folder, never through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """A stream of an events table's files; the local timestamps become instants, as watermarks need."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Count and value sum per day and event type, closed by the watermark."""
    grouped = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, lateness: str = "1 day") -> DataFrame:
    """Runs of a user's events with no pause of `gap` or more."""
    grouped = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_closed(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs an aggregation over all that is there in append mode and returns the groups that the watermark has closed; a later run with the same folder goes on from there."""
    folder = folder or shared_folder(df.sparkSession)
    query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def run_updates(df: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Runs an aggregation over all that is there in update mode and returns each group as it was written last; open groups are in it.

    Each batch writes the groups that changed under its own number, so a batch that is run again replaces its rows.
    """
    folder = folder or shared_folder(df.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in df.columns if c not in keys]
    written = df.sparkSession.read.schema(df.schema.add("batch", "long")).parquet(f"{folder}/rows")
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
