"""Denormalized facts: sales, inventory and transfers with their store and product columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.geo import haversine_km
from shelfwise.functions.notes import DEFAULT_RISK, risk_label, risk_score, score_of_label
from shelfwise.sources.tables import dealt

STORE_COLUMNS = ["store_name", "region", "climate_zone", "city", "store_lat", "store_lng"]
PRODUCT_COLUMNS = ["product_name", "category", "subcategory", "seasonality"]
PRICE_COLUMNS = ["price_usd", "cost_usd"]


def silver_sales(sales: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    return (
        sales.join(stores, "store_id")
        .join(products, "product_id")
        .select(
            "store_id", *STORE_COLUMNS, "product_id", *PRODUCT_COLUMNS,
            "sale_date", "units_sold", "net_sales_usd", "channel",
        )
    )


def note_flags(inventory: DataFrame, label=risk_label) -> DataFrame:
    """Distinct notes with their score. Worth it when ``label`` is a costly classifier: it then
    runs once per distinct note instead of once per row."""
    notes = inventory.select("merch_note_text").where(F.col("merch_note_text").isNotNull()).distinct()
    return notes.withColumn("markdown_risk_score", score_of_label(label(F.col("merch_note_text"))))


def silver_inventory(
    inventory: DataFrame,
    stores: DataFrame,
    products: DataFrame,
    flags: DataFrame | None = None,
    keep: list[str] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Inventory with dimensions and markdown risk.

    Without ``flags`` the rules score each row in place, with no join: a join on the note text
    would shuffle all inventory onto a handful of phrases. With ``flags`` (from a costly
    classifier) the scores are joined in, and a note without a flag scores as healthy. ``keep``
    names more columns to carry along. ``tasks`` deals the rows by product in so many tasks: the join
    with the products, and what is grouped by product after it, need no other shuffle.
    """
    joined = dealt(inventory.join(stores, "store_id"), tasks, "product_id").join(products, "product_id")
    if flags is None:
        scored = joined.withColumn("markdown_risk_score", risk_score(F.col("merch_note_text")))
    else:
        scored = joined.join(flags, "merch_note_text", "left").withColumn(
            "markdown_risk_score",
            F.coalesce("markdown_risk_score", F.lit(DEFAULT_RISK).cast("decimal(2,1)")),
        )
    return scored.select(
        "store_id", *STORE_COLUMNS, "product_id", *PRODUCT_COLUMNS, *PRICE_COLUMNS,
        "snapshot_date", "on_hand_units", "on_order_units", "merch_note_text", "markdown_risk_score",
        *(keep or []),
    )


def silver_transfers(transfers: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Moves with both stores' columns; moves without a source store keep NULLs and no distance."""
    source = stores.select(
        F.col("store_id").alias("from_store_id"), F.col("region").alias("from_region"),
        F.col("climate_zone").alias("from_climate"), F.col("store_lat").alias("from_lat"),
        F.col("store_lng").alias("from_lng"),
    )
    target = stores.select(
        F.col("store_id").alias("to_store_id"), F.col("region").alias("to_region"),
        F.col("climate_zone").alias("to_climate"), F.col("store_lat").alias("to_lat"),
        F.col("store_lng").alias("to_lng"),
    )
    item = products.select(
        "product_id", "product_name", "category", "price_usd", F.col("cost_usd").alias("product_cost_usd")
    )
    distance = haversine_km(F.col("from_lat"), F.col("from_lng"), F.col("to_lat"), F.col("to_lng"))
    known = F.col("from_lat").isNotNull() & F.col("to_lat").isNotNull()
    return (
        transfers.join(item, "product_id")
        .join(target, "to_store_id")
        .join(source, "from_store_id", "left")
        .withColumn("distance_km", F.when(known, distance))
        .select(
            "transfer_id", "product_id", "product_name", "category", "price_usd", "product_cost_usd",
            "move_type", "from_store_id", "from_region", "from_climate", "to_store_id", "to_region",
            "to_climate", "substitute_product_id", "units_moved", "initiated_date", "days_to_fulfill",
            "recaptured_sales_usd", "margin_impact_usd", "cost_usd", "distance_km",
        )
    )


def transfer_outcomes(silver: DataFrame) -> DataFrame:
    margin = (F.col("price_usd") - F.col("product_cost_usd")) / F.nullif(F.col("price_usd"), F.lit(0))
    return silver.withColumn("margin_pct", margin).select(
        "transfer_id", "product_id", "move_type", "units_moved", "distance_km", "days_to_fulfill",
        "price_usd", "margin_pct", "recaptured_sales_usd", "margin_impact_usd", "cost_usd",
    )
