"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.scratch import stage

MAX_ROUNDS = 50


def _hung(edges: DataFrame, both: bool) -> DataFrame:
    """Hang neighbours under the least one. Large star: larger neighbours under the least of all.
    Small star: smaller ones and the node itself. A node with many neighbours is met by a join
    that Spark may split; nothing is gathered per node."""
    pairs = edges.select("a", "b")  # a > b
    if both:
        pairs = pairs.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(stage(least, "least"), "a")
    if both:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            joined.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every node of the edges (a, b) but the roots themselves; the root is the
    least node of its component. Self loops and repeats are ignored."""
    now = stage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(),
        "edges",
    )
    state = None
    for _ in range(MAX_ROUNDS):
        now = stage(_hung(stage(_hung(now, True), "large"), False), "small")
        # a sum of all pairs, exact in decimals: it stops changing when every tree is a star
        new = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if new == state:
            return now.select("a", F.col("b").alias("root"))
        state = new
    raise RuntimeError("components did not settle")
