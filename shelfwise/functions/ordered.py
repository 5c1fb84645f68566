"""Ordered per-key computations that stay balanced when one key holds most of the rows.

A plain window over a hot key sorts all its rows in one task. Here every function takes a
``bucket`` column that never decreases along the order (a day, or an order key divided by a
constant), works within (key, bucket), and joins in one summary row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(
    df: DataFrame, keys: list[str], bucket: str, order: list, name: str, start: DataFrame | None = None
) -> DataFrame:
    """Row numbers per key, from 1 as row_number over (keys, order) gives them, or going on from
    the ``start`` of a key (columns: keys, start)."""
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    if start is not None:
        # joined to the few bucket rows, not to the rows themselves
        offsets = (
            offsets.join(start, keys, "left")
            .withColumn("_before", F.col("_before") + F.coalesce("start", F.lit(0)))
            .drop("start")
        )
    local = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return (
        df.withColumn(name, local)
        .join(offsets, [*keys, bucket])
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_before")
    )


def next_value(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, name: str
) -> DataFrame:
    """The value of the following row per key, equal to lead(value) over (keys, order)."""
    heads = df.groupBy(*keys, bucket).agg(F.min_by(value, F.struct(*order)).alias("_head"))
    following = F.lead("_head").over(Window.partitionBy(*keys).orderBy(bucket))
    heads = heads.withColumn("_next_head", following).drop("_head")
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    # lead() gives NULL both past the end and for a NULL value; the row count tells them apart
    return (
        df.withColumn("_is_last", F.lead(F.lit(1)).over(within).isNull())
        .withColumn(name, F.lead(value).over(within))
        .join(heads, [*keys, bucket])
        .withColumn(name, F.when(F.col("_is_last"), F.col("_next_head")).otherwise(F.col(name)))
        .drop("_is_last", "_next_head")
    )
