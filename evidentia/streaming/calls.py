"""Streaming forms: files as they arrive, running totals of calls, and a cache of recent answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def arriving_files(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """(path, content, length) of new files under ``path``, at most ``per_batch`` a micro-batch."""
    return spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_batch).load(path).filter("length > 0")


def running_totals(calls: DataFrame, ts: str = "ts", by: str = "model", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls and cost by window and model; rows later than ``late`` are dropped and their windows closed."""
    return calls.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count("*").alias("n_calls"), F.sum("cost").alias("total_cost"))


def first_requests(requests: DataFrame, ts: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """Each key once in its time to live: what a response cache would let through."""
    return requests.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["key"])
