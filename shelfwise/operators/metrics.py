"""Metric layer: named dimensions and measures, evaluated at the grain a query asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.tables import dealt

DIMENSIONS = ["climate_zone", "region", "category", "position_status", "product_id", "product_name"]
ROLLUP_DIMENSIONS = ["climate_zone", "region", "category", "position_status", "product_id"]


def _count_of(status: str) -> Column:
    return F.sum(F.when(F.col("position_status") == status, 1).otherwise(0))


def _total(col: str) -> Column:
    """A sum taken before the change to double: exact for decimals, in whatever order rows come."""
    return F.sum(col).cast("double")


MEASURES: dict[str, Callable[[], Column]] = {
    "lost_sales_exposure": lambda: F.sum("lost_sales_exposure_usd"),
    "markdown_exposure": lambda: F.sum("markdown_exposure_usd"),
    "on_hand_units": lambda: F.sum("on_hand_units"),
    "recent_units_7d": lambda: F.sum("recent_units_7d"),
    "recent_net_sales_7d": lambda: F.sum("recent_net_sales_7d"),
    "position_count": lambda: F.count(F.lit(1)),
    "stockout_count": lambda: _count_of("stockout"),
    "overstock_count": lambda: _count_of("overstock"),
    "avg_weeks_of_supply": lambda: _total("weeks_of_supply") / F.nullif(F.count("weeks_of_supply"), F.lit(0)),
    "avg_markdown_risk": lambda: _total("markdown_risk_score") / F.nullif(F.count("markdown_risk_score"), F.lit(0)),
}

# Averages do not add up, so the rollup carries their sum and count.
AVERAGED = {"avg_weeks_of_supply": "weeks_of_supply", "avg_markdown_risk": "markdown_risk_score"}


def measure(
    df: DataFrame, dims: list[str], measures: list[str], where: Column | None = None
) -> DataFrame:
    """Evaluate the measures per combination of dims, over the rows that pass ``where``."""
    unknown = [d for d in dims if d not in DIMENSIONS] + [m for m in measures if m not in MEASURES]
    if unknown:
        raise KeyError(f"not in the metric layer: {unknown}")
    rows = df if where is None else df.where(where)
    return rows.groupBy(*dims).agg(*[MEASURES[m]().alias(m) for m in measures])


def rollup_base(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """All measures on the rollup dimensions, in a form that adds up; in so many tasks, or as Spark deals them."""
    sums = [MEASURES[m]().alias(m) for m in MEASURES if m not in AVERAGED]
    parts = []
    for name, col in AVERAGED.items():
        parts += [F.sum(col).alias(f"{name}_sum"), F.count(col).alias(f"{name}_n")]
    return dealt(df, tasks, *ROLLUP_DIMENSIONS).groupBy(*ROLLUP_DIMENSIONS).agg(*sums, *parts)


def from_rollup(base: DataFrame, dims: list[str], measures: list[str]) -> DataFrame:
    """Coarser measures from the rollup."""
    out = []
    for m in measures:
        if m in AVERAGED:
            value = _total(f"{m}_sum") / F.nullif(F.sum(f"{m}_n"), F.lit(0))
        else:
            value = F.sum(m)
        out.append(value.alias(m))
    return base.groupBy(*dims).agg(*out)


def dim_filter(**values: str | None) -> Column:
    """Global filters on zone, region, category, status; an unset one lets all rows pass."""
    allowed = {"climate_zone", "region", "category", "position_status"}
    keep = F.lit(True)
    for name, value in values.items():
        if name not in allowed:
            raise KeyError(f"not a global filter: {name}")
        if value is not None:
            keep = keep & (F.col(name) == value)
    return keep
