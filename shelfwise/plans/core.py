"""Queries of the core: silver facts, the spine, shortfalls, moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import position as pos
from shelfwise.operators import recovery as rec
from shelfwise.operators import silver
from shelfwise.plans.frames import Retail
from shelfwise.plans.registry import query

SPINE = (
    "store_id:i store_name:s region:s climate_zone:s city:s store_lat:4 store_lng:4 product_id:i "
    "product_name:s category:s subcategory:s seasonality:s on_hand_units:i on_order_units:i price_usd:2 "
    "markdown_risk_score:1 recent_units_7d:i recent_net_sales_7d:2 avg_daily_velocity:6 weeks_of_supply:6 "
    "lost_sales_exposure_usd:2 markdown_exposure_usd:2 position_status:s"
)
SHORTFALL = (
    "store_id:i product_id:i store_lat:4 store_lng:4 region:s on_hand_units:i avg_daily_velocity:6 "
    "price_usd:2 lost_sales_exposure_usd:2 nearest_surplus_store_id:i nearest_surplus_on_hand:i "
    "nearest_surplus_distance_km:4"
)


@query(
    "silver_sales",
    "store_id:i store_name:s region:s climate_zone:s city:s store_lat:4 store_lng:4 product_id:i "
    "product_name:s category:s subcategory:s seasonality:s sale_date:d units_sold:i net_sales_usd:4 channel:s",
    "SELECT * FROM silver_sales",
)
def silver_sales(r: Retail) -> DataFrame:
    return r.silver_sales


SILVER_INVENTORY = (
    "store_id:i store_name:s region:s climate_zone:s city:s store_lat:4 store_lng:4 product_id:i "
    "product_name:s category:s subcategory:s seasonality:s price_usd:2 cost_usd:4 snapshot_date:d "
    "on_hand_units:i on_order_units:i merch_note_text:s "
    "markdown_risk_score:1"
)


@query("silver_inventory", SILVER_INVENTORY, "SELECT * FROM silver_inventory")
def silver_inventory(r: Retail) -> DataFrame:
    return r.silver_inventory


@query(
    "silver_transfers",
    "transfer_id:i product_id:i product_name:s category:s price_usd:2 product_cost_usd:4 move_type:s "
    "from_store_id:i from_region:s from_climate:s to_store_id:i to_region:s to_climate:s "
    "substitute_product_id:i units_moved:i initiated_date:d days_to_fulfill:i recaptured_sales_usd:2 "
    "margin_impact_usd:2 cost_usd:2 distance_km:4",
    "SELECT * FROM silver_transfers",
)
def silver_transfers(r: Retail) -> DataFrame:
    return r.silver_transfers


@query(
    "transfer_outcomes",
    "transfer_id:i product_id:i move_type:s units_moved:i distance_km:4 days_to_fulfill:i price_usd:2 "
    "margin_pct:4 recaptured_sales_usd:2 margin_impact_usd:2 cost_usd:2",
    "SELECT * FROM transfer_outcomes",
)
def transfer_outcomes(r: Retail) -> DataFrame:
    return r.outcomes


@query("current_snapshot", SILVER_INVENTORY, "SELECT * FROM current_stock")
def current_snapshot(r: Retail) -> DataFrame:
    return pos.current_snapshot(r.silver_inventory, as_of=r.newest)


@query(
    "trailing_window_filter",
    "store_id:i product_id:i sale_date:d units_sold:i net_sales_usd:4 channel:s",
    "SELECT * FROM raw_sales WHERE sale_date > (SELECT MAX(sale_date) FROM raw_sales) - INTERVAL 7 DAYS",
)
def trailing_window_filter(r: Retail) -> DataFrame:
    return pos.trailing_window(r.sales)


@query(
    "recent_sales_7d",
    "store_id:i product_id:i recent_units_7d:i recent_net_sales_7d:2",
    "SELECT * FROM recent_sales",
)
def recent_sales_7d(r: Retail) -> DataFrame:
    return pos.recent_sales(r.silver_sales, as_of=r.newest)


@query(
    "position_base_join",
    "store_id:i product_id:i on_hand_units:i recent_units_7d:i recent_net_sales_7d:2",
    "SELECT * FROM position_base",
)
def position_base_join(r: Retail) -> DataFrame:
    return pos.join_recent_sales(
        pos.current_snapshot(r.silver_inventory, r.newest), pos.recent_sales(r.silver_sales, as_of=r.newest)
    )


@query(
    "position_metrics",
    "store_id:i product_id:i on_hand_units:i recent_units_7d:i avg_daily_velocity:6 weeks_of_supply:6",
    "SELECT * FROM position_metrics",
)
def position_metrics(r: Retail) -> DataFrame:
    return pos.with_metrics(position_base_join(r))


@query(
    "exposures",
    "store_id:i product_id:i lost_sales_exposure_usd:2 markdown_exposure_usd:2",
    "SELECT * FROM positions",
)
def exposures(r: Retail) -> DataFrame:
    return pos.with_exposures(position_metrics(r))


@query("position_status", "store_id:i product_id:i position_status:s", "SELECT * FROM positions")
def position_status(r: Retail) -> DataFrame:
    return pos.with_status(position_metrics(r))


@query("store_sku_position", SPINE, "SELECT * FROM positions")
def store_sku_position(r: Retail) -> DataFrame:
    return r.position


@query(
    "note_risk_score",
    "merch_note_text:s markdown_risk_score:1",
    "SELECT * FROM note_flags",
)
def note_risk_score(r: Retail) -> DataFrame:
    return silver.note_flags(r.inventory)


@query(
    "distinct_notes",
    "merch_note_text:s",
    "SELECT DISTINCT merch_note_text FROM raw_inventory WHERE merch_note_text IS NOT NULL",
)
def distinct_notes(r: Retail) -> DataFrame:
    return silver.note_flags(r.inventory)


@query("nearest_surplus", SHORTFALL, "SELECT * FROM shortfalls")
def nearest_surplus(r: Retail) -> DataFrame:
    return rec.knn_surplus(r.flagged, 1)


@query("knn_surplus", SHORTFALL + " nth:i", """
SELECT * EXCLUDE (nth), CASE WHEN nearest_surplus_store_id IS NOT NULL THEN nth END AS nth FROM surplus_ranked WHERE nth <= 3""")
def knn_surplus(r: Retail) -> DataFrame:
    return rec.knn_surplus(r.flagged, 3)


@query("rank_nearest", "store_id:i product_id:i nearest_surplus_store_id:i nth:i", """
SELECT * EXCLUDE (nth), CASE WHEN nearest_surplus_store_id IS NOT NULL THEN nth END AS nth FROM surplus_ranked WHERE nth <= 5""")
def rank_nearest(r: Retail) -> DataFrame:
    return rec.knn_surplus(r.flagged, 5)


@query("open_shortfalls", SHORTFALL, "SELECT * FROM shortfalls")
def open_shortfalls(r: Retail) -> DataFrame:
    return r.shortfalls


@query("available_products", "product_id:i any_on_hand:i", "SELECT * FROM available_products")
def available_products(r: Retail) -> DataFrame:
    return r.available


@query("substitute_candidates", "product_id:i subcategory:s price_usd:2", """
SELECT p.product_id, subcategory, price_usd FROM raw_products p
JOIN available_products a ON a.product_id = p.product_id WHERE seasonality = 'cold_weather'""")
def substitute_candidates(r: Retail) -> DataFrame:
    return rec.substitute_candidates(r.products, r.available)


@query("rank_substitute", "product_id:i subcategory:s price_usd:2 substitute_product_id:i price_gap:2", """
SELECT product_id, subcategory, price_usd, substitute_product_id, price_gap FROM (
  SELECT own.product_id, own.subcategory, own.price_usd, sub.product_id AS substitute_product_id,
    ABS(sub.price_usd - own.price_usd) AS price_gap,
    ROW_NUMBER() OVER (PARTITION BY own.product_id ORDER BY ABS(sub.price_usd - own.price_usd), sub.product_id) AS rn
  FROM raw_products own JOIN raw_products sub ON sub.subcategory = own.subcategory
    AND sub.seasonality = 'cold_weather' AND sub.product_id <> own.product_id
  JOIN available_products a ON a.product_id = sub.product_id
) AS ranked_products WHERE rn = 1""")
def rank_substitute(r: Retail) -> DataFrame:
    wanted = r.products.select("product_id", "subcategory", "price_usd")
    candidates = rec.substitute_candidates(r.products, r.available)
    return rec.closest_substitutes(wanted, candidates)


@query("substitute_pick", "store_id:i product_id:i substitute_product_id:i price_gap:2", "SELECT * FROM substitutes")
def substitute_pick(r: Retail) -> DataFrame:
    short = rec.shortfalls(r.flagged)
    return rec.substitute_pick(short, r.products, r.available)


@query(
    "move_economics",
    "store_id:i product_id:i units_needed:i transfer_units:i transfer_recaptured:2 transfer_cost:2 "
    "expedite_recaptured:2 expedite_cost:2 substitute_recaptured:2 substitute_margin_impact:2",
    "SELECT * FROM economics",
)
def move_economics(r: Retail) -> DataFrame:
    return rec.with_economics(r.shortfalls)


@query(
    "move_scores",
    "store_id:i product_id:i transfer_net:2 expedite_net:2 substitute_net:2",
    "SELECT * FROM scored",
)
def move_scores(r: Retail) -> DataFrame:
    return rec.with_scores(rec.with_economics(r.shortfalls))


@query(
    "recommended_move",
    "store_id:i product_id:i recommended_move:s recommended_units:i predicted_recaptured_usd:2 "
    "predicted_net_value_usd:2",
    "SELECT * FROM recommended",
)
def recommended_move(r: Retail) -> DataFrame:
    return rec.with_recommended_move(move_scores(r))


@query(
    "move_ranking_json",
    "store_id:i product_id:i listed:i move:s recaptured:2 net:2 cost:2",
    "SELECT * FROM move_options",
)
def move_ranking_json(r: Retail) -> DataFrame:
    from shelfwise.sources.tables import parse_move_ranking

    text = F.to_json(rec.move_ranking())
    ranked = move_scores(r).select("store_id", "product_id", text.alias("move_ranking"))
    moves = F.posexplode(parse_move_ranking(F.col("move_ranking"))).alias("listed", "option")
    return ranked.select("store_id", "product_id", moves).select("store_id", "product_id", "listed", "option.*")


@query(
    "move_ranking_sorted",
    "store_id:i product_id:i move:s recaptured:2 net:2 cost:2 move_rank:i",
    """SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id, product_id ORDER BY net DESC, listed) AS move_rank
FROM move_options""",
)
def move_ranking_sorted(r: Retail) -> DataFrame:
    return rec.ranked_moves(move_scores(r))


RECOMMENDATION = (
    "store_id:i product_id:i recommended_move:s recommended_source_store_id:i "
    "recommended_substitute_product_id:i recommended_units:i predicted_recaptured_usd:2 "
    "predicted_net_value_usd:2"
)


@query("recovery_recommendations", RECOMMENDATION, "SELECT * FROM recommended")
def recovery_recommendations(r: Retail) -> DataFrame:
    return r.recommendations


@query("recovery_recommendations_strict", RECOMMENDATION, """
SELECT * EXCLUDE (recommended_source_store_id, recommended_substitute_product_id),
  CASE WHEN recommended_move = 'transfer' THEN recommended_source_store_id END AS recommended_source_store_id,
  CASE WHEN recommended_move = 'substitute' THEN recommended_substitute_product_id END AS recommended_substitute_product_id
FROM recommended""")
def recovery_recommendations_strict(r: Retail) -> DataFrame:
    return rec.strict_recommendations(r.recommendations)
