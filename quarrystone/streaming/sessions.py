"""Event streams: sessions with late data, repeated events dropped, files by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A stream of the Parquet files in ``folder`` whose name matches; event time as a timestamp, which watermarks ask for."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def session_counts(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n, total) of sessions; an event_id counts once within the time that data may be late."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    s = once.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n", "total")


def write_by_day(events: DataFrame, path: str, checkpoint: str):
    """Appends a stream to files by day; returns the running query."""
    return events.withColumn("day", F.to_date("ts")).writeStream.partitionBy("day").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
