"""Model-call log as a stream: outcomes per minute and rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.guard import call_outcome

LATENESS = "10 minutes"


def outcomes_per_minute(calls: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Finished one-minute windows with the calls per outcome."""
    return (
        calls.withColumn("outcome", call_outcome(F.col("response")))
        .withWatermark("request_time", lateness)
        .groupBy(F.window("request_time", "1 minute").alias("w"), "outcome")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("minute"), "outcome", "n")
    )


def windows_over_limit(
    calls: DataFrame, limit: int, keys: list[str], width: str = "1 minute", lateness: str = LATENESS
) -> DataFrame:
    """Finished windows with more calls than allowed, per key."""
    return (
        calls.withWatermark("request_time", lateness)
        .groupBy(*keys, F.window("request_time", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .where(F.col("calls") > limit)
        .select(*keys, F.col("w.start").alias("window_start"), "calls", (F.col("calls") - limit).alias("refused"))
    )
