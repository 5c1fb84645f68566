"""Change feed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.changelog import ORDER, images


def newest_images(changes: DataFrame) -> DataFrame:
    """Newest image per id as running state. The log position decides, not the arrival, so a
    change that comes late never overwrites a newer one. State: one row per id."""
    values = [c for c in changes.columns if c != "id"]
    newest = F.max_by(F.struct(*values), F.struct(*ORDER)).alias("image")
    return images(changes).groupBy("id").agg(newest)


def current_rows(log: DataFrame) -> DataFrame:
    """Current state from the upsert log: the newest batch per id, without the deleted."""
    newest = F.max_by("image", "batch_id").alias("image")
    return (
        log.groupBy("id").agg(newest).select("id", "image.*").where(F.col("change_type") != "delete")
    )
