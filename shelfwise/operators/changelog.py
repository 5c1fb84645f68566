"""Change feed to current state and to history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.ordered import next_value

ORDER = ["lsn", "sort_by"]
# One bucket spans this many log positions: a hot id is spread over many buckets.
LSN_PER_BUCKET = 100_000


def images(changes: DataFrame) -> DataFrame:
    """All changes but before-images."""
    return changes.where(F.col("change_type") != "update_preimage")


def current_state(changes: DataFrame) -> DataFrame:
    """Newest image per id by log order; deleted ids drop out. An aggregate with map-side
    combine, so an id with very many changes does not travel whole."""
    values = [c for c in changes.columns if c != "id"]
    newest = F.max_by(F.struct(*values), F.struct(*ORDER)).alias("_row")
    return (
        images(changes)
        .groupBy("id")
        .agg(newest)
        .select("id", "_row.*")
        .where(F.col("change_type") != "delete")
    )


def history(changes: DataFrame, lsn_per_bucket: int = LSN_PER_BUCKET) -> DataFrame:
    """Validity intervals per id: each image holds until the next change. A delete ends the
    interval before it and opens none."""
    ordered = next_value(
        images(changes).withColumn("_bucket", F.floor(F.col("lsn") / lsn_per_bucket)),
        ["id"], "_bucket", ORDER, F.col("change_ts"), "valid_to",
    )
    return (
        ordered.drop("_bucket")
        .withColumnRenamed("change_ts", "valid_from")
        .where(F.col("change_type") != "delete")
        .withColumn("is_current", F.col("valid_to").isNull())
    )
