"""Operations queue: filters, live state, lookups, top lists and store rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.position import OPEN_STATUSES, is_open

KEY = ["store_id", "product_id"]
QUEUE_LIMIT = 300
STORE_LIMIT = 500
MAX_LIMIT = 200

# Urgency order of statuses, map bubble sizes.
STATUS_RANK = {"stockout": 0, "at_risk": 1, "overstock": 2, "healthy": 3}
RADIUS_MIN, RADIUS_MAX, RADIUS_SCALE = 5.0, 32.0, 2.6


def clamp_limit(limit: int | None, default: int, cap: int = MAX_LIMIT) -> int:
    return default if limit is None or limit < 1 else min(limit, cap)


def queue_filter(
    status_group: str = "open",
    status: str | None = None,
    zone: str | None = None,
    category: str | None = None,
    store: Column | None = None,
    sku: Column | None = None,
    group: list[str] | None = None,
) -> Column:
    """Predicate of the queue. A status overrides the group; the group ``open`` means stockout
    and at-risk unless ``group`` names other statuses."""
    keep = F.lit(True)
    if status is not None:
        keep = F.col("position_status") == status
    elif status_group == "open":
        keep = F.col("position_status").isin(group or OPEN_STATUSES)
    wanted = {"climate_zone": zone, "category": category, "store_id": store, "product_id": sku}
    for name, value in wanted.items():
        if value is not None:
            keep = keep & (F.col(name) == value)
    return keep


def text_filter(query: str, columns: tuple = ("store_name", "city", "product_name", "product_id")) -> Column:
    """Case-insensitive substring over the columns; a blank query keeps every row."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))).contains(wanted)
    return hit


def latest_actions(actions: DataFrame) -> DataFrame:
    """Newest action per position, markdown holds aside. An aggregate, so that a position with
    very many actions shrinks before the shuffle."""
    values = [c for c in actions.columns if c not in KEY]
    newest = F.max_by(F.struct(*values), F.struct("created_at", "id")).alias("_row")
    return (
        actions.where(F.col("move_type") != "markdown_hold").groupBy(*KEY).agg(newest).select(*KEY, "_row.*")
    )


def with_live_state(position: DataFrame, recommendations: DataFrame, actions: DataFrame) -> DataFrame:
    """Positions with the recommended move and the newest action."""
    advice = recommendations.select(*KEY, "recommended_move", "predicted_recaptured_usd")
    live = latest_actions(actions).select(
        *KEY, F.col("move_type").alias("live_move_type"), F.col("status").alias("action_status")
    )
    return (
        position.join(advice, KEY, "left")
        .join(live, KEY, "left")
        .withColumn("id", F.concat_ws(":", "store_id", "product_id"))
    )


def in_progress() -> Column:
    return F.col("live_move_type").isNotNull()


def queue_order(sort: str = "exposure") -> list[Column]:
    """Sort keys; store and product break ties."""
    if sort == "velocity":
        keys = [F.desc_nulls_last("avg_daily_velocity")]
    else:
        keys = [F.desc_nulls_last("lost_sales_exposure_usd"), F.desc_nulls_last("markdown_exposure_usd")]
    return [*keys, F.col("store_id"), F.col("product_id")]


def top_queue(rows: DataFrame, sort: str = "exposure", limit: int = QUEUE_LIMIT) -> DataFrame:
    return rows.orderBy(*queue_order(sort)).limit(limit)


def worst_shortfalls(position: DataFrame, limit: int = 20) -> DataFrame:
    open_rows = position.where(is_open()).orderBy(
        F.desc_nulls_last("lost_sales_exposure_usd"), "store_id", "product_id"
    )
    return open_rows.limit(limit).withColumnRenamed("on_hand_units", "on_hand")


def worst_per_zone(position: DataFrame, k: int) -> DataFrame:
    """The k worst open positions of every climate zone. The rank filter runs before the
    shuffle too, so a zone that holds most rows does not travel whole."""
    order = Window.partitionBy("climate_zone").orderBy(
        F.desc_nulls_last("lost_sales_exposure_usd"), "store_id", "product_id"
    )
    ranked = position.where(is_open()).withColumn("zone_rank", F.row_number().over(order))
    return ranked.where(F.col("zone_rank") <= k)


def markdown_risks(position: DataFrame, limit: int | None = None, zone: str | None = None) -> DataFrame:
    """Overstock by markdown exposure."""
    rows = position.where(queue_filter(status="overstock", zone=zone)).orderBy(
        F.desc_nulls_last("markdown_exposure_usd"), "store_id", "product_id"
    )
    return rows if limit is None else rows.limit(limit)


def zero_on_hand(shortfalls: DataFrame, sku: Column, limit: int = 10) -> DataFrame:
    """Stores without any stock of a product, most exposed first."""
    return (
        shortfalls.where((F.col("product_id") == sku) & (F.col("on_hand_units") == 0))
        .orderBy(F.desc_nulls_last("lost_sales_exposure_usd"), "store_id")
        .limit(limit)
    )


def worst_one(shortfalls: DataFrame) -> DataFrame:
    return shortfalls.orderBy(
        F.desc_nulls_last("lost_sales_exposure_usd"), "store_id", "product_id"
    ).limit(1)


def shortfall_lookup(
    shortfalls: DataFrame, position: DataFrame, store: Column | None = None, sku: Column | None = None
) -> DataFrame:
    """The shortfall of a store and product, or the worst one unless both are given, with names
    and weeks of supply. No row means not found."""
    if store is None or sku is None:
        found = worst_one(shortfalls)
    else:
        found = shortfalls.where((F.col("store_id") == store) & (F.col("product_id") == sku)).limit(1)
    names = position.select(*KEY, "store_name", "city", "product_name", "weeks_of_supply")
    return found.join(names, KEY, "left")


def acted_keys(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("move_type") != "markdown_hold").select(*KEY).distinct()


def kpi_summary(position: DataFrame, actions: DataFrame) -> DataFrame:
    """Header numbers: exposure and count of open positions without action, markdown exposure,
    and open positions with an action."""
    marked = position.join(acted_keys(actions).withColumn("acted", F.lit(True)), KEY, "left")
    waiting = is_open() & F.col("acted").isNull()

    def total(col: str, keep: Column) -> Column:
        return F.coalesce(F.sum(F.when(keep, F.col(col))), F.lit(0)).alias(col)

    return marked.agg(
        total("lost_sales_exposure_usd", waiting),
        total("markdown_exposure_usd", F.col("position_status") == "overstock"),
        F.count_if(waiting).alias("open_shortfalls"),
        F.count_if(is_open() & F.col("acted").isNotNull()).alias("recoveries_in_progress"),
    )


def located() -> Column:
    return F.col("store_lat").isNotNull() & F.col("store_lng").isNotNull()


def store_breakdown(position: DataFrame, keep: Column | None = None, limit: int | None = STORE_LIMIT) -> DataFrame:
    """One row per store for the map, with its most urgent status. Stores without coordinates
    drop out."""
    if keep is None:
        keep = queue_filter(group=["stockout", "at_risk", "overstock"])
    rank = F.lit(max(STATUS_RANK.values()))
    for status, value in STATUS_RANK.items():
        rank = F.when(F.col("position_status") == status, value).otherwise(rank)
    names = F.array(*[F.lit(s) for s in sorted(STATUS_RANK, key=STATUS_RANK.get)])
    stores = (
        position.where(located() & keep)
        .groupBy("store_id")
        .agg(
            *[F.max(c).alias(c) for c in ("store_name", "city", "region", "climate_zone")],
            F.avg("store_lat").alias("lat"),
            F.avg("store_lng").alias("lng"),
            F.count(F.lit(1)).alias("positions"),
            (F.coalesce(F.sum("recent_units_7d"), F.lit(0)) / F.lit(7.0)).alias("recent_velocity"),
            F.coalesce(F.sum("lost_sales_exposure_usd"), F.lit(0)).alias("lost_sales_exposure_usd"),
            F.coalesce(F.sum("markdown_exposure_usd"), F.lit(0)).alias("markdown_exposure_usd"),
            F.min(rank).alias("worst_rank"),
        )
        .withColumn("status", F.element_at(names, F.col("worst_rank") + 1))
    )
    if limit is None:
        return stores
    return stores.orderBy(F.desc("lost_sales_exposure_usd"), "store_id").limit(limit)


def map_extent(breakdown: DataFrame) -> DataFrame:
    return breakdown.agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lng").alias("min_lng"),
        F.max("lng").alias("max_lng"), F.sum("positions").alias("total_positions"),
    )


def bubble_radius(velocity: Column) -> Column:
    grown = F.sqrt(F.greatest(F.lit(1.0), velocity)) * F.lit(RADIUS_SCALE)
    return F.greatest(F.lit(RADIUS_MIN), F.least(F.lit(RADIUS_MAX), grown))


def status_mix(position: DataFrame, keep: Column) -> DataFrame:
    """Count per zone and status of the kept positions, healthy ones aside."""
    return (
        position.where(keep & (F.col("position_status") != "healthy"))
        .groupBy("climate_zone", "position_status")
        .agg(F.count(F.lit(1)).alias("position_count"))
    )


def product_status_drill(position: DataFrame) -> DataFrame:
    return (
        position.where(F.col("position_status") != "healthy")
        .groupBy("product_name", "position_status")
        .agg(
            F.count(F.lit(1)).alias("position_count"),
            F.sum("lost_sales_exposure_usd").alias("total_lost_sales_usd"),
            F.sum("markdown_exposure_usd").alias("total_markdown_usd"),
        )
        .orderBy(F.desc("total_lost_sales_usd"), F.desc("total_markdown_usd"))
    )


def recovery_portfolio(recommendations: DataFrame) -> DataFrame:
    return (
        recommendations.groupBy("recommended_move")
        .agg(
            F.count(F.lit(1)).alias("shortfall_count"),
            F.sum("predicted_recaptured_usd").alias("total_recaptured_usd"),
            F.sum("predicted_net_value_usd").alias("total_net_value_usd"),
        )
        .orderBy(F.desc("total_recaptured_usd"))
    )


def recommendation_list(recommendations: DataFrame, position: DataFrame) -> DataFrame:
    names = position.select(*KEY, "store_name", "product_name")
    return recommendations.join(names, KEY).orderBy(F.desc("predicted_net_value_usd"), *KEY)


def view_score(position: DataFrame, k: int = 5) -> DataFrame:
    """One row: the k worst open positions as an array, the open count, and the worst key."""
    entry = F.struct(
        F.struct(
            (-F.coalesce("lost_sales_exposure_usd", F.lit(0))).cast("double").alias("minus"),
            "store_id", "product_id",
        ).alias("by"),
        F.struct(
            "store_id", "product_id", "store_name", "city",
            F.round(F.coalesce("lost_sales_exposure_usd", F.lit(0)), 2)
            .cast("double")
            .alias("lost_sales_exposure_usd"),
        ).alias("row"),
    )
    open_rows = position.where(is_open())
    worst = open_rows.orderBy(F.desc_nulls_last("lost_sales_exposure_usd"), *KEY).limit(k)
    top = worst.agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["row"]).alias("top"))
    total = open_rows.agg(F.count(F.lit(1))).scalar()
    payload = F.struct("open_shortfall_count", F.col("top").alias("top_shortfalls"))
    return top.withColumn("open_shortfall_count", total).withColumns(
        {
            "store_id": F.get(F.col("top.store_id"), F.lit(0)),
            "product_id": F.get(F.col("top.product_id"), F.lit(0)),
            "payload": F.to_json(payload),
        }
    )


def priority_band(dollars: Column) -> Column:
    """1 (most urgent) to 5 by predicted recaptured sales."""
    return (
        F.when(dollars >= 2000, 1).when(dollars >= 1000, 2).when(dollars >= 500, 3).when(dollars >= 100, 4)
        .otherwise(5)
    )


def add_priority(actions: DataFrame) -> DataFrame:
    """Schema change: a priority column with default 3, for tables that lack it."""
    return actions if "priority" in actions.columns else actions.withColumn("priority", F.lit(3))


def backfill_priority(actions: DataFrame) -> DataFrame:
    banded = add_priority(actions).withColumn(
        "priority", priority_band(F.col("predicted_recaptured_usd"))
    )
    return banded.where(F.col("priority").between(1, 5))
