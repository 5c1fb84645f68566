"""The spine: one row per store and product with velocity, supply, exposure and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_DAYS = 7
HORIZON_DAYS = 30
MARKDOWN_DEPTH = "0.3"
OVERSTOCK_WEEKS = 8
RISK_GATE = "0.6"
NO_SALES_WEEKS = "9999.0"

OPEN_STATUSES = ["stockout", "at_risk"]
STATUSES = ["stockout", "at_risk", "overstock", "healthy"]

POSITION_COLUMNS = [
    "store_id", "store_name", "region", "climate_zone", "city", "store_lat", "store_lng",
    "product_id", "product_name", "category", "subcategory", "seasonality",
    "on_hand_units", "on_order_units", "price_usd", "markdown_risk_score",
    "recent_units_7d", "recent_net_sales_7d", "avg_daily_velocity", "weeks_of_supply",
    "lost_sales_exposure_usd", "markdown_exposure_usd", "position_status",
]


def _latest(df: DataFrame, date_col: str, as_of: Column | None) -> Column:
    """The given date, or else the newest date in the data as a scalar subquery. A literal
    lets the scan prune files by date; the subquery reads the date column once."""
    return as_of if as_of is not None else df.agg(F.max(date_col)).scalar()


def current_snapshot(inventory: DataFrame, as_of: Column | None = None) -> DataFrame:
    return inventory.where(F.col("snapshot_date") == _latest(inventory, "snapshot_date", as_of))


def trailing_window(sales: DataFrame, days: int = WINDOW_DAYS, as_of: Column | None = None) -> DataFrame:
    """Sales after the newest date minus ``days``; the bound itself is excluded."""
    return sales.where(F.col("sale_date") > F.date_sub(_latest(sales, "sale_date", as_of), days))


def recent_sales(sales: DataFrame, days: int = WINDOW_DAYS, as_of: Column | None = None) -> DataFrame:
    return trailing_window(sales, days, as_of).groupBy("store_id", "product_id").agg(
        F.sum("units_sold").alias("recent_units_7d"), F.sum("net_sales_usd").alias("recent_net_sales_7d")
    )


def join_recent_sales(snapshot: DataFrame, recent: DataFrame) -> DataFrame:
    return snapshot.join(recent, ["store_id", "product_id"], "left").withColumns(
        {
            "recent_units_7d": F.coalesce("recent_units_7d", F.lit(0).cast("bigint")),
            "recent_net_sales_7d": F.coalesce("recent_net_sales_7d", F.lit(0)),
        }
    )


def with_metrics(joined: DataFrame) -> DataFrame:
    """Velocity as a decimal of six places (7 as a decimal literal keeps it one), and weeks of
    supply: the sentinel for stock that does not sell, NULL for neither stock nor sales."""
    idle = (F.col("on_hand_units") > 0) & (F.col("recent_units_7d") == 0)
    weekly = F.nullif(F.col("avg_daily_velocity") * 7, F.lit(0))
    return joined.withColumn("avg_daily_velocity", F.expr("recent_units_7d / 7.0")).withColumn(
        "weeks_of_supply", F.when(idle, F.expr(NO_SALES_WEEKS)).otherwise(F.col("on_hand_units") / weekly)
    )


def _weeks_or(default: int) -> Column:
    return F.coalesce("weeks_of_supply", F.lit(default))


def _overstocked() -> Column:
    return (_weeks_or(0) > OVERSTOCK_WEEKS) & (F.col("markdown_risk_score") >= F.expr(RISK_GATE))


def with_exposures(metrics: DataFrame) -> DataFrame:
    velocity, price = F.col("avg_daily_velocity"), F.col("price_usd")
    short = (F.col("on_hand_units") == 0) | (_weeks_or(0) < 1)
    excess = F.col("on_hand_units") - velocity * HORIZON_DAYS
    lost = F.when(short, F.greatest(F.lit(0), velocity * price * HORIZON_DAYS)).otherwise(F.lit(0))
    markdown = F.when(
        _overstocked(), F.greatest(F.lit(0), excess * price * F.expr(MARKDOWN_DEPTH))
    ).otherwise(F.lit(0))
    return metrics.withColumns({"lost_sales_exposure_usd": lost, "markdown_exposure_usd": markdown})


def with_status(metrics: DataFrame) -> DataFrame:
    """First matching rule wins. A missing weeks of supply counts as 999 for at-risk and as 0
    for overstock."""
    selling = F.col("avg_daily_velocity") > 0
    status = (
        F.when((F.col("on_hand_units") == 0) & selling, "stockout")
        .when((_weeks_or(999) < 1) & selling, "at_risk")
        .when(_overstocked(), "overstock")
        .otherwise("healthy")
    )
    return metrics.withColumn("position_status", status)


def store_sku_position(
    inventory: DataFrame,
    sales: DataFrame,
    as_of: Column | None = None,
    sales_as_of: Column | None = None,
    days: int = WINDOW_DAYS,
) -> DataFrame:
    """The full spine from silver inventory and silver sales."""
    snapshot = current_snapshot(inventory, as_of)
    joined = join_recent_sales(snapshot, recent_sales(sales, days, sales_as_of))
    return with_status(with_exposures(with_metrics(joined))).select(*POSITION_COLUMNS)


def is_open() -> Column:
    return F.col("position_status").isin(OPEN_STATUSES)
