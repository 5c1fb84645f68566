"""Sales and move history: daily grids, trends, traffic, move features and learned rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["store_id", "product_id"]
TREND_DAYS = 56


def velocity_trend(sales: DataFrame, keep: Column, days: int = TREND_DAYS, as_of: Column | None = None) -> DataFrame:
    """Units per week and zone over the last days before as_of, or else before the newest sale."""
    newest = as_of if as_of is not None else sales.agg(F.max("sale_date")).scalar()
    return (
        sales.where(keep & (F.col("sale_date") >= F.date_sub(newest, days)))
        .groupBy(F.date_trunc("week", "sale_date").alias("week"), "climate_zone")
        .agg(F.sum("units_sold").alias("units_sold"))
    )


def sales_profile(sales: DataFrame) -> DataFrame:
    """Rows, stores, products and date range. Counting two distinct columns at once would copy
    every row per column; one row per pair is few enough for that."""
    pairs = sales.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("sale_date").alias("first_date"), F.max("sale_date").alias("last_date")
    )
    return pairs.agg(
        F.sum("n").alias("row_count"),
        F.countDistinct("store_id").alias("stores"),
        F.countDistinct("product_id").alias("products"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )


def daily_grid(pairs: DataFrame, sales: DataFrame, days: int) -> DataFrame:
    """Every day of the window for each given store and product, days without sales at 0. The
    days come from a sequence per pair, and sales are summed per day before the join."""
    newest = sales.agg(F.max("sale_date")).scalar()
    first = F.date_sub(newest, days - 1)
    daily = (
        sales.where(F.col("sale_date") >= first)
        .groupBy(*KEY, "sale_date")
        .agg(F.sum("units_sold").alias("units_sold"))
    )
    return (
        pairs.select(*KEY)
        .distinct()
        .withColumn("sale_date", F.explode(F.sequence(first, newest)))
        .join(daily, [*KEY, "sale_date"], "left")
        .withColumn("units_sold", F.coalesce("units_sold", F.lit(0).cast("bigint")))
    )


def traffic_profile(traffic: DataFrame, sales: DataFrame) -> DataFrame:
    """Per store and weekday: average visitors, average units, units per visitor."""
    visitors = (
        traffic.groupBy("store_id", F.dayofweek("traffic_date").alias("weekday"))
        .agg(F.avg("traffic_count").alias("avg_traffic"))
    )
    daily = sales.groupBy("store_id", "sale_date").agg(F.sum("units_sold").alias("units"))
    units = daily.groupBy("store_id", F.dayofweek("sale_date").alias("weekday")).agg(
        F.avg("units").alias("avg_units")
    )
    return visitors.join(units, ["store_id", "weekday"], "left").withColumn(
        "units_per_visitor", F.col("avg_units") / F.nullif(F.col("avg_traffic"), F.lit(0.0))
    )


def outcomes_by_move(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("move_type").agg(
        F.count(F.lit(1)).alias("moves"),
        F.avg("recaptured_sales_usd").alias("avg_recaptured_usd"),
        F.avg("cost_usd").alias("avg_cost_usd"),
        (F.sum("recaptured_sales_usd") / F.nullif(F.sum("cost_usd"), F.lit(0.0))).alias("recaptured_per_cost"),
    )


def learned_coefficients(outcomes: DataFrame) -> DataFrame:
    """Rates of the move heuristic as the history shows them: recaptured share of the moved value,
    cost per unit, and for moves with a distance the cost line over it."""
    moved_value = F.nullif(F.col("units_moved") * F.col("price_usd").cast("double"), F.lit(0.0))
    return outcomes.groupBy("move_type").agg(
        F.avg(F.col("recaptured_sales_usd") / moved_value).alias("recapture_rate"),
        F.avg(F.col("cost_usd") / F.nullif(F.col("units_moved"), F.lit(0))).alias("cost_per_unit"),
        F.regr_slope("cost_usd", "distance_km").alias("cost_per_km"),
        F.regr_intercept("cost_usd", "distance_km").alias("base_cost"),
        F.avg(F.col("margin_impact_usd") / moved_value).alias("margin_loss_rate"),
    )


def _asked_days(moves: DataFrame, store: str) -> DataFrame:
    return moves.where(F.col(store).isNotNull()).select(
        F.col(store).alias("store_id"), "product_id", F.col("initiated_date").alias("day"), F.lit(1).alias("asked")
    )


def _timeline(rows: DataFrame, tasks: int | None) -> DataFrame:
    """Rows dealt by store and product only: sums per day and ordered windows need no further shuffle."""
    return rows.repartition(tasks, *KEY) if tasks else rows.repartition(*KEY)


def move_features(
    moves: DataFrame, stock: DataFrame, sales: DataFrame, days: int = 7, tasks: int | None = None
) -> DataFrame:
    """Moves with what was known on their day: the last stock count of the source up to that day,
    and the units sold per day at the destination over the ``days`` before it.

    Each feature is read off a timeline of asked days and facts, summed to one row per store,
    product and day before the ordered window. So even a hot pair has at most one row per
    calendar day there, and no range join is needed. The features then join back to the moves. A
    timeline is shuffled once, in so many tasks or as Spark deals it.
    """
    by_day = Window.partitionBy(*KEY).orderBy("_day")
    counts = stock.select(*KEY, F.col("snapshot_date").alias("day"), "on_hand_units")
    known_stock = (
        _timeline(_asked_days(moves, "from_store_id").unionByName(counts, allowMissingColumns=True), tasks)
        .groupBy(*KEY, "day")
        .agg(F.max("asked").alias("asked"), F.max("on_hand_units").alias("on_hand"))
        .withColumn("_day", F.unix_date("day"))
        .withColumn(
            "from_on_hand_at_move",
            F.last("on_hand", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .where(F.col("asked").isNotNull() & F.col("from_on_hand_at_move").isNotNull())
        .select(
            F.col("store_id").alias("from_store_id"), "product_id", F.col("day").alias("initiated_date"),
            "from_on_hand_at_move",
        )
    )
    sold = sales.select(*KEY, F.col("sale_date").alias("day"), "units_sold")
    known_sales = (
        _timeline(_asked_days(moves, "to_store_id").unionByName(sold, allowMissingColumns=True), tasks)
        .groupBy(*KEY, "day")
        .agg(F.max("asked").alias("asked"), F.sum("units_sold").alias("units"))
        .withColumn("_day", F.unix_date("day"))
        .withColumn("before", F.sum("units").over(by_day.rangeBetween(-days, -1)))
        .where(F.col("asked").isNotNull() & F.col("before").isNotNull())
        .select(
            F.col("store_id").alias("to_store_id"), "product_id", F.col("day").alias("initiated_date"),
            (F.col("before") / F.lit(float(days))).alias("to_velocity_at_move"),
        )
    )
    return (
        moves.join(known_stock, ["from_store_id", "product_id", "initiated_date"], "left")
        .join(known_sales, ["to_store_id", "product_id", "initiated_date"], "left")
        .withColumn("to_velocity_at_move", F.coalesce("to_velocity_at_move", F.lit(0.0)))
    )
