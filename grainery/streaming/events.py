"""Streams of file events: coalescing by quiet time, and incremental passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of event files; times become timestamps, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def watched(path: Column, store: str = ".grainery", history: str = ".git") -> Column:
    """Whether an event's path lies outside the index and the version control folder, whose changes start no refresh."""
    return ~_under(path, store) & ~_under(path, history)


def _under(path: Column, folder: str) -> Column:
    return (path == folder) | path.startswith(folder + "/")


def debounced(events: DataFrame, by: str, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(by, start, end, n): bursts of events that end with a quiet time; works on streams and on tables."""
    bursts = events.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), by).agg(F.count("*").alias("n"))
    return bursts.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def incremental(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls `step` once for every batch of what has arrived, remembers how far it came, and stops."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def leases(beats: DataFrame, by: str, ttl: str = "90 seconds", late: str = "10 minutes") -> DataFrame:
    """(by, start, expires, beats): a lease lives from its first heartbeat until one is missing for `ttl`; works on streams and on tables.

    Two beats just `ttl` apart are one lease.
    """
    held = beats.withWatermark("ts", late).groupBy(F.session_window("ts", ttl).alias("w"), by).agg(F.count("*").alias("beats"))
    return held.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("expires"), "beats")
