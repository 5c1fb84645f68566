"""Read-only mirrors: normalize rows, insert unseen keys, reset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.position import STATUSES
from shelfwise.operators.recovery import MOVES


def mirror_key() -> Column:
    return F.concat_ws(":", "store_id", "product_id")


def normalize(df: DataFrame) -> DataFrame:
    """Mirror shape: key, numbers as doubles, unknown status as healthy, unknown move as NULL."""
    changes = {"id": mirror_key()}
    for name, kind in df.dtypes:
        if kind.startswith("decimal"):
            changes[name] = F.col(name).cast("double")
    if "position_status" in df.columns:
        status = F.col("position_status")
        changes["position_status"] = F.when(status.isin(STATUSES), status).otherwise("healthy")
    if "recommended_move" in df.columns:
        move = F.col("recommended_move")
        changes["recommended_move"] = F.when(move.isin([*MOVES, "markdown_hold"]), move)
    return df.withColumns(changes)


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row per key in the given order, by aggregation."""
    values = [c for c in df.columns if c not in key]
    pick = F.min_by(F.struct(*values), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(pick).select(*key, "_row.*").select(*df.columns)


def insert_absent(target: DataFrame, source: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Target plus the source rows of unseen keys; of repeated source keys the first row wins."""
    unseen = source.join(target.select(*key), key, "left_anti")
    return target.unionByName(first_per_key(unseen, key, order))


def reset(writable: dict[str, DataFrame], mirrors: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Writable tables emptied, mirrors taken anew."""
    return {**{name: df.limit(0) for name, df in writable.items()}, **mirrors}
