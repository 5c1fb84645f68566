"""Model-call log: usage, blocks, tokens, rate limits and attribution to stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.guard import GUARD_MARK, LIMIT_MARK, call_outcome


def _blocks(mark: str, name: str) -> Column:
    return F.sum(F.col("response").contains(mark).cast("int")).alias(name)


def usage_by_requester(calls: DataFrame) -> DataFrame:
    return calls.groupBy("requester").agg(
        F.count(F.lit(1)).alias("calls"),
        _blocks(LIMIT_MARK, "threshold_blocks"),
        _blocks(GUARD_MARK, "guardrail_blocks"),
    )


def totals(calls: DataFrame) -> DataFrame:
    return calls.agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.countDistinct("requester").alias("principals"),
        _blocks(LIMIT_MARK, "threshold_blocks"),
        _blocks(GUARD_MARK, "guardrail_blocks"),
    )


def tokens_by_requester(calls: DataFrame) -> DataFrame:
    """Calls and tokens, tokens from the usage field of the response JSON."""
    used = F.get_json_object("response", "$.usage.total_tokens").cast("bigint")
    return calls.groupBy("requester").agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(used), F.lit(0)).alias("total_tokens")
    )


def outcomes_per_minute(calls: DataFrame) -> DataFrame:
    return (
        calls.withColumn("outcome", call_outcome(F.col("response")))
        .groupBy(F.date_trunc("minute", "request_time").alias("minute"), "outcome")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def windows_over_limit(calls: DataFrame, limit: int, keys: list[str], unit: str = "minute") -> DataFrame:
    """Windows with more calls than allowed, per key columns (none: the whole endpoint)."""
    return (
        calls.groupBy(*keys, F.date_trunc(unit, "request_time").alias("window_start"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .where(F.col("calls") > limit)
        .withColumn("refused", F.col("calls") - limit)
    )


def refused_calls(calls: DataFrame, limit: int, keys: list[str], unit: str = "minute") -> DataFrame:
    """The calls beyond the first ``limit`` of their window. Only the first calls of each window
    are ranked (that filter also runs before the shuffle); the last one allowed is the cut that
    all calls of the window are compared with."""
    windowed = calls.withColumn("window_start", F.date_trunc(unit, "request_time"))
    by = [*keys, "window_start"]
    place = F.row_number().over(Window.partitionBy(*by).orderBy("request_time", "event_id"))
    cut = (
        windowed.select(*dict.fromkeys([*by, "request_time", "event_id"]))
        .withColumn("_place", place)
        .where(F.col("_place") <= limit)
        .groupBy(*by)
        .agg(F.max(F.struct("request_time", "event_id")).alias("_cut"))
    )
    return (
        windowed.join(cut, by)
        .where(F.struct("request_time", "event_id") > F.col("_cut"))
        .drop("_cut")
    )


def cost_by_store(calls: DataFrame, actions: DataFrame) -> DataFrame:
    """Calls attributed to the stores their requester acted on. Both sides shrink to one row per
    requester (and store) before they meet; ``call_share`` splits a requester's calls evenly."""
    per_user = calls.groupBy("requester").agg(F.count(F.lit(1)).alias("calls"))
    acted = actions.select(F.col("approved_by").alias("requester"), "store_id").where(
        F.col("requester").isNotNull()
    ).distinct()
    spread = acted.groupBy("requester").agg(F.count(F.lit(1)).alias("stores"))
    return (
        acted.join(per_user.join(spread, "requester"), "requester")
        .groupBy("store_id")
        .agg(
            F.count(F.lit(1)).alias("requesters"),
            F.sum("calls").alias("calls"),
            F.sum(F.col("calls") / F.col("stores")).alias("call_share"),
        )
    )
