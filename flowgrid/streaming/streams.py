"""Streaming forms of unloading, edge load and trip sessions over an event feed (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.functions.storage import fresh_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LATE = "1 hour"


def events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The feed as a stream; times without a zone are UTC, as the session's zone is."""
    feed = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder)
    return feed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def unload_stream(feed: DataFrame, wide: str = "15 minutes") -> DataFrame:
    """start, n: arrivals by tumbling window."""
    return feed.groupBy(F.window("ts", wide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def edge_load_stream(feed: DataFrame, wide: str = "15 minutes", step: str = "5 minutes") -> DataFrame:
    """start, edge, flux, speed: what each edge (here the event type) carries, by sliding window."""
    out = feed.groupBy(F.window("ts", wide, step), F.col("event_type").alias("edge")).agg(F.count("*").alias("flux"), F.avg("value").alias("speed"))
    return out.select(F.col("window.start").alias("start"), "edge", "flux", "speed")


def trip_sessions(feed: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, end, pings: trips as pings without a longer gap."""
    out = feed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("pings"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "pings")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Everything that is there now, through the stream to files in the shared folder; windows still open to late rows stay in state."""
    spark = stream.sparkSession
    out = fresh_path(spark, name)
    q = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{out}-state").format("parquet").start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
