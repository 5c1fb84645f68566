"""Metric rollups that are kept up by changes instead of being computed anew.

A rollup is a folder of parts: one from the positions at the start, then one for each batch of changed
rows. A batch holds the old image of a changed row with sign -1 and the new one with sign +1, so its
part adds what came and takes away what went. Every part is as small as the rollup, not as the
positions. The rollup is the sum of its parts; a group that lost its last row is gone. Sums carry the
number of values that are not NULL, so that a sum over none stays NULL.

A batch writes below its number with overwrite: one that runs again replaces its own part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.metrics import DIMENSIONS, MEASURES
from shelfwise.sources.tables import dealt

# Measure: the column it sums, or the status it counts.
SUMS = {
    "lost_sales_exposure": "lost_sales_exposure_usd",
    "markdown_exposure": "markdown_exposure_usd",
    "on_hand_units": "on_hand_units",
    "recent_units_7d": "recent_units_7d",
    "recent_net_sales_7d": "recent_net_sales_7d",
    "avg_weeks_of_supply": "weeks_of_supply",
    "avg_markdown_risk": "markdown_risk_score",
}
COUNTS = {"stockout_count": "stockout", "overstock_count": "overstock"}
AVERAGES = ["avg_weeks_of_supply", "avg_markdown_risk"]


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.withColumn("sign", F.lit(sign))


def columns(dims: list[str]) -> list[str]:
    """The columns of the positions that a rollup on these dimensions reads."""
    return list(dict.fromkeys([*dims, *SUMS.values(), "position_status"]))


def changes_between(old: DataFrame, new: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows that differ, with their sign. Rows that repeat count as often as they do. One shuffle:
    old and new rows cancel out; in so many tasks, or as Spark deals them."""
    both = signed(old, -1).unionByName(signed(new, 1))
    net = dealt(both, tasks, *old.columns).groupBy(*old.columns).agg(F.sum("sign").cast("int").alias("net"))
    times = F.array_repeat(F.signum("net").cast("int"), F.abs("net"))
    return net.where(F.col("net") != 0).select(*old.columns, F.explode(times).alias("sign"))


def part(changes: DataFrame, dims: list[str], tasks: int | None = None) -> DataFrame:
    """A batch of signed rows on the rollup's dimensions, in a form that adds up. Products make nearly
    as many groups as there are rows: by them the rows are dealt first, in so many tasks."""
    plus = F.col("sign") > 0
    sums: list[Column] = []
    for name, column in SUMS.items():
        value = F.col(column)
        sums.append(F.sum(F.when(plus, value).otherwise(-value)).alias(f"{name}_sum"))
        sums.append(F.sum(F.when(value.isNotNull(), F.col("sign"))).cast("bigint").alias(f"{name}_n"))
    for name, status in COUNTS.items():
        sums.append(F.sum(F.when(F.col("position_status") == status, F.col("sign")).otherwise(0)).alias(name))
    rows = dealt(changes, tasks if "product_id" in dims else None, *dims)
    return rows.groupBy(*dims).agg(*sums, F.sum("sign").alias("position_count"))


@dataclass(frozen=True)
class Rollup:
    """A rollup on some dimensions, kept in a folder."""

    spark: SparkSession
    path: str
    dims: tuple[str, ...]
    tasks: int | None = None

    def start(self, positions: DataFrame) -> Rollup:
        return self.add(signed(positions, 1), 0)

    def add(self, changes: DataFrame, batch_id: int) -> Rollup:
        part(changes, list(self.dims), self.tasks).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        return self

    def parts(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path)

    def rows(self, dims: list[str] | None = None) -> DataFrame:
        """The sum of the parts, on the rollup's dimensions or fewer."""
        own = list(self.dims) if dims is None else dims
        parts = self.parts()
        values = [c for c in parts.columns if c not in (*self.dims, "batch_id")]
        return parts.groupBy(*own).agg(*[F.sum(c).alias(c) for c in values]).where(F.col("position_count") > 0)

    def compacted(self, path: str) -> Rollup:
        """The same rollup as one part in a new folder."""
        self.rows().write.mode("overwrite").parquet(f"{path}/batch_id=0")
        return Rollup(self.spark, path, self.dims, self.tasks)

    def measure(self, dims: list[str], measures: list[str]) -> DataFrame:
        """As metrics.measure() over the positions."""
        unknown = [d for d in dims if d not in DIMENSIONS] + [m for m in measures if m not in MEASURES]
        if unknown:
            raise KeyError(f"not in the metric layer: {unknown}")
        if not set(dims) <= set(self.dims):
            raise KeyError(f"the rollup holds {self.dims}, not {dims}")
        out = []
        for name in measures:
            total, n = F.col(f"{name}_sum") if name in SUMS else F.col(name), F.col(f"{name}_n") if name in SUMS else None
            if name in AVERAGES:
                value = F.when(n > 0, total.cast("double") / n)
            elif name in SUMS:
                value = F.when(n > 0, total)
            else:
                value = total
            out.append(value.alias(name))
        return self.rows(dims).select(*dims, *out)


def smallest(rollups: list[Rollup], dims: list[str]) -> Rollup:
    """Of the rollups that hold the dimensions, the one with the fewest rows to read. The counts
    come from the files' footers."""
    fit = [r for r in rollups if set(dims) <= set(r.dims)]
    if not fit:
        raise KeyError(f"no rollup holds {dims}")
    return min(fit, key=lambda r: (r.parts().count(), len(r.dims)))
