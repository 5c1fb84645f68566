"""Queries of the metric layer, dashboards and the operations queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import history, metrics, queue, rollup, sketches
from shelfwise.operators import position as pos
from shelfwise.plans.frames import Retail
from shelfwise.plans.registry import query
from shelfwise.sources import fixtures as fx
from shelfwise.sources.scratch import scratch_dir, stage

ALL_MEASURES = list(metrics.MEASURES)
MEASURE_SPEC = (
    "lost_sales_exposure:2 markdown_exposure:2 on_hand_units:i recent_units_7d:i recent_net_sales_7d:2 "
    "position_count:i stockout_count:i overstock_count:i avg_weeks_of_supply:4 avg_markdown_risk:4"
)
MEASURE_SQL = """SUM(lost_sales_exposure_usd) AS lost_sales_exposure, SUM(markdown_exposure_usd) AS markdown_exposure,
  SUM(on_hand_units) AS on_hand_units, SUM(recent_units_7d) AS recent_units_7d, SUM(recent_net_sales_7d) AS recent_net_sales_7d,
  COUNT(*) AS position_count, COUNT(*) FILTER (WHERE position_status = 'stockout') AS stockout_count,
  COUNT(*) FILTER (WHERE position_status = 'overstock') AS overstock_count,
  AVG(CAST(weeks_of_supply AS DOUBLE)) AS avg_weeks_of_supply, SUM(CAST(markdown_risk_score AS DECIMAL(18,1)))::DOUBLE / NULLIF(COUNT(markdown_risk_score), 0) AS avg_markdown_risk"""

OPEN = "position_status IN ('stockout', 'at_risk')"
WORST = "ORDER BY lost_sales_exposure_usd DESC NULLS LAST, store_id, product_id"


def affected() -> Column:
    """The products the season hits: cold-weather goods."""
    return F.col("seasonality") == "cold_weather"


@query("metric_view", f"climate_zone:s category:s {MEASURE_SPEC}",
       f"SELECT climate_zone, category, {MEASURE_SQL} FROM positions GROUP BY climate_zone, category")
def metric_view(r: Retail) -> DataFrame:
    return metrics.measure(r.position, ["climate_zone", "category"], ALL_MEASURES)


@query("metric_view_by_product", f"product_id:i product_name:s {MEASURE_SPEC}",
       f"""SELECT product_id, product_name, {MEASURE_SQL} FROM positions WHERE region = 'ASIA'
GROUP BY product_id, product_name""")
def metric_view_by_product(r: Retail) -> DataFrame:
    keep = metrics.dim_filter(region="ASIA")
    return metrics.measure(r.position, ["product_id", "product_name"], ALL_MEASURES, keep)


@query("metric_view_all_products", f"product_id:i product_name:s {MEASURE_SPEC}",
       f"SELECT product_id, product_name, {MEASURE_SQL} FROM positions GROUP BY product_id, product_name")
def metric_view_all_products(r: Retail) -> DataFrame:
    return metrics.measure(r.position, ["product_id", "product_name"], ALL_MEASURES)


@query("metric_rollup", f"region:s position_status:s {MEASURE_SPEC}",
       f"SELECT region, position_status, {MEASURE_SQL} FROM positions GROUP BY region, position_status")
def metric_rollup(r: Retail) -> DataFrame:
    base = metrics.rollup_base(r.position, fx.sale_tasks(r.spark, r.sf_dir))
    return metrics.from_rollup(base, ["region", "position_status"], ALL_MEASURES)


@query("metric_rollup_deltas", f"climate_zone:s category:s {MEASURE_SPEC}",
       f"SELECT climate_zone, category, {MEASURE_SQL} FROM positions GROUP BY climate_zone, category")
def metric_rollup_deltas(r: Retail) -> DataFrame:
    """The metric view from rollups that were made two days ago and have followed the changes since."""

    tasks = fx.sale_tasks(r.spark, r.sf_dir)

    def spine(back: int) -> DataFrame:
        day = F.date_sub(r.newest, back)
        sold = r.silver_sales.where(F.col("sale_date") <= day)
        found = pos.store_sku_position(r.silver_inventory, sold, as_of=day, sales_as_of=day)
        # like rows side by side: the changes are shuffled in far fewer bytes
        like = ["category", "position_status", "region", "climate_zone", "product_id"]
        return stage(found.select(*rollup.columns(metrics.ROLLUP_DIMENSIONS)).sortWithinPartitions(*like), "spine")

    old = spine(2)
    kept = [
        rollup.Rollup(r.spark, scratch_dir(r.spark, "rollup"), tuple(dims), tasks).start(old)
        for dims in (metrics.ROLLUP_DIMENSIONS, ["climate_zone", "category", "region"])
    ]
    for batch, back in enumerate((1, 0), 1):
        new = spine(back)
        changes = stage(rollup.changes_between(old, new, tasks), "changes")
        kept = [each.add(changes, batch) for each in kept]
        old = new
    return rollup.smallest(kept, ["climate_zone", "category"]).measure(["climate_zone", "category"], ALL_MEASURES)


@query("metric_headline", "lost_sales_exposure:2 markdown_exposure:2",
       f"SELECT {MEASURE_SQL} FROM positions")
def metric_headline(r: Retail) -> DataFrame:
    return metrics.measure(r.position, [], ["lost_sales_exposure", "markdown_exposure"])


@query("metric_by_zone", "climate_zone:s stockout_count:i overstock_count:i",
       f"SELECT climate_zone, {MEASURE_SQL} FROM positions GROUP BY climate_zone")
def metric_by_zone(r: Retail) -> DataFrame:
    return metrics.measure(r.position, ["climate_zone"], ["stockout_count", "overstock_count"]).orderBy(
        "climate_zone"
    )


DASHBOARD = ["lost_sales_exposure", "markdown_exposure", "stockout_count", "overstock_count", "position_count"]


@query("dashboard_exposure_set",
       "climate_zone:s region:s category:s position_status:s lost_sales_exposure:2 markdown_exposure:2 "
       "stockout_count:i overstock_count:i position_count:i",
       f"""SELECT climate_zone, region, category, position_status, {MEASURE_SQL} FROM positions
GROUP BY climate_zone, region, category, position_status""")
def dashboard_exposure_set(r: Retail) -> DataFrame:
    dims = ["climate_zone", "region", "category", "position_status"]
    return metrics.measure(r.position, dims, DASHBOARD)


@query("region_rollup",
       "region:s category:s lost_sales_exposure:2 markdown_exposure:2 stockout_count:i overstock_count:i position_count:i",
       f"SELECT region, category, {MEASURE_SQL} FROM positions GROUP BY region, category")
def region_rollup(r: Retail) -> DataFrame:
    return metrics.measure(r.position, ["region", "category"], DASHBOARD)


@query("exposure_by_category", "category:s lost_sales_exposure:2 markdown_exposure:2",
       f"SELECT category, {MEASURE_SQL} FROM positions GROUP BY category")
def exposure_by_category(r: Retail) -> DataFrame:
    return metrics.measure(r.position, ["category"], ["lost_sales_exposure", "markdown_exposure"])


@query("avg_weeks_of_supply_selling", "climate_zone:s avg_weeks_of_supply:4",
       """SELECT climate_zone, AVG(CAST(weeks_of_supply AS DOUBLE)) AS avg_weeks_of_supply FROM positions
WHERE recent_units_7d > 0 GROUP BY climate_zone""")
def avg_weeks_of_supply_selling(r: Retail) -> DataFrame:
    return metrics.measure(
        r.position, ["climate_zone"], ["avg_weeks_of_supply"], F.col("recent_units_7d") > 0
    )


@query("dim_filters", "store_id:i product_id:i climate_zone:s region:s category:s position_status:s",
       """SELECT * FROM positions WHERE climate_zone = 'North' AND region = 'EUROPE' AND position_status = 'overstock'""")
def dim_filters(r: Retail) -> DataFrame:
    return r.position.where(
        metrics.dim_filter(climate_zone="North", region="EUROPE", category=None, position_status="overstock")
    )


@query("open_shortfall_count", "open_shortfalls:i", f"SELECT COUNT(*) AS open_shortfalls FROM positions WHERE {OPEN}")
def open_shortfall_count(r: Retail) -> DataFrame:
    return r.position.where(pos.is_open()).agg(F.count(F.lit(1)).alias("open_shortfalls"))


WORST_SPEC = (
    "store_name:s city:s product_name:s on_hand:i avg_daily_velocity:2 lost_sales_exposure_usd:2"
)


@query("worst_shortfalls", WORST_SPEC,
       f"SELECT *, on_hand_units AS on_hand FROM positions WHERE {OPEN} {WORST} LIMIT 20")
def worst_shortfalls(r: Retail) -> DataFrame:
    return queue.worst_shortfalls(r.position)


@query("synced_top10", "store_id:i product_id:i lost_sales_exposure_usd:2 nearest_surplus_store_id:i",
       f"SELECT * FROM shortfalls {WORST} LIMIT 10")
def synced_top10(r: Retail) -> DataFrame:
    return r.shortfalls.orderBy(*queue.queue_order()[:1], "store_id", "product_id").limit(10)


@query("south_markdown_risk",
       "store_id:i product_id:i store_name:s city:s product_name:s on_hand_units:i weeks_of_supply:4 markdown_exposure_usd:2",
       """SELECT * FROM positions WHERE position_status = 'overstock' AND climate_zone = 'South'
ORDER BY markdown_exposure_usd DESC NULLS LAST, store_id, product_id LIMIT 20""")
def south_markdown_risk(r: Retail) -> DataFrame:
    return queue.markdown_risks(r.position, 20, "South")


@query("worst_stockouts_table",
       "store_id:i product_id:i store_name:s city:s product_name:s on_hand_units:i recent_units_7d:i lost_sales_exposure_usd:2",
       f"SELECT * FROM positions WHERE {OPEN}")
def worst_stockouts_table(r: Retail) -> DataFrame:
    return r.position.where(pos.is_open()).orderBy(*queue.queue_order())


@query("markdown_risk_table",
       "store_id:i product_id:i store_name:s city:s product_name:s on_hand_units:i weeks_of_supply:4 markdown_exposure_usd:2",
       "SELECT * FROM positions WHERE position_status = 'overstock'")
def markdown_risk_table(r: Retail) -> DataFrame:
    return queue.markdown_risks(r.position)


@query("zone_drilldown", "climate_zone:s zone_rank:i store_id:i product_id:i lost_sales_exposure_usd:2",
       f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY climate_zone
  ORDER BY lost_sales_exposure_usd DESC NULLS LAST, store_id, product_id) AS zone_rank
FROM positions WHERE {OPEN}) AS by_zone WHERE zone_rank <= 5""")
def zone_drilldown(r: Retail) -> DataFrame:
    return queue.worst_per_zone(r.position, 5)


@query("position_mix_by_zone", "climate_zone:s position_status:s position_count:i",
       """SELECT climate_zone, position_status, COUNT(*) AS position_count FROM positions
WHERE seasonality = 'cold_weather' AND position_status <> 'healthy' GROUP BY climate_zone, position_status""")
def position_mix_by_zone(r: Retail) -> DataFrame:
    return queue.status_mix(r.position, affected()).orderBy("climate_zone", "position_status")


@query("product_status_drill",
       "product_name:s position_status:s position_count:i total_lost_sales_usd:2 total_markdown_usd:2",
       """SELECT product_name, position_status, COUNT(*) AS position_count, SUM(lost_sales_exposure_usd) AS total_lost_sales_usd,
  SUM(markdown_exposure_usd) AS total_markdown_usd FROM positions WHERE position_status <> 'healthy' GROUP BY ALL""")
def product_status_drill(r: Retail) -> DataFrame:
    return queue.product_status_drill(r.position)


@query("null_location_filter", "store_id:i product_id:i store_lat:4 store_lng:4 position_status:s",
       "SELECT * FROM positions WHERE store_lat IS NOT NULL AND store_lng IS NOT NULL")
def null_location_filter(r: Retail) -> DataFrame:
    return r.position.where(queue.located())


BREAKDOWN = """SELECT s.*, store_lat AS lat, store_lng AS lng, positions, units / 7::DOUBLE AS recent_velocity,
  lost_sales_exposure_usd, markdown_exposure_usd,
  CASE WHEN stockouts > 0 THEN 'stockout' WHEN at_risks > 0 THEN 'at_risk' ELSE 'overstock' END AS status
FROM raw_stores s JOIN (
  SELECT store_id, COUNT(*) AS positions, SUM(recent_units_7d) AS units,
    SUM(lost_sales_exposure_usd) AS lost_sales_exposure_usd, SUM(markdown_exposure_usd) AS markdown_exposure_usd,
    COUNT(*) FILTER (position_status = 'stockout') AS stockouts, COUNT(*) FILTER (position_status = 'at_risk') AS at_risks
  FROM positions WHERE position_status <> 'healthy' GROUP BY store_id) AS per_store USING (store_id)
"""
BREAKDOWN_LIST = f"{BREAKDOWN}ORDER BY lost_sales_exposure_usd DESC, store_id LIMIT 500"


@query("store_breakdown",
       "store_id:i store_name:s city:s region:s climate_zone:s lat:4 lng:4 positions:i recent_velocity:4 "
       "lost_sales_exposure_usd:2 markdown_exposure_usd:2 status:s", BREAKDOWN_LIST)
def store_breakdown(r: Retail) -> DataFrame:
    return queue.store_breakdown(r.position)


@query("map_extent", "min_lat:4 max_lat:4 min_lng:4 max_lng:4 total_positions:i",
       f"""SELECT MIN(lat) AS min_lat, MAX(lat) AS max_lat, MIN(lng) AS min_lng, MAX(lng) AS max_lng,
  SUM(positions) AS total_positions FROM ({BREAKDOWN}) AS stores_on_map""")
def map_extent(r: Retail) -> DataFrame:
    return queue.map_extent(queue.store_breakdown(r.position, limit=None))


@query("map_bubbles", "store_id:i status:s radius:4",
       f"""SELECT store_id, status, GREATEST(CAST(5 AS DOUBLE), LEAST(CAST(32 AS DOUBLE),
  SQRT(GREATEST(CAST(1 AS DOUBLE), recent_velocity)) * CAST(2.6 AS DOUBLE))) AS radius
FROM ({BREAKDOWN}) AS stores_on_map""")
def map_bubbles(r: Retail) -> DataFrame:
    return queue.store_breakdown(r.position, limit=None).withColumn("radius", queue.bubble_radius(F.col("recent_velocity")))


@query("top_n_view_score",
       "open_shortfall_count:i place:i store_id:i product_id:i store_name:s city:s lost_sales_exposure_usd:2",
       f"""SELECT *, ROW_NUMBER() OVER ({WORST}) - 1 AS place,
  (SELECT COUNT(*) FROM positions WHERE {OPEN}) AS open_shortfall_count
FROM positions WHERE {OPEN} {WORST} LIMIT 5""")
def top_n_view_score(r: Retail) -> DataFrame:
    score = queue.view_score(r.flagged)
    return score.select("open_shortfall_count", F.posexplode("top").alias("place", "t")).select(
        "open_shortfall_count", "place", "t.*"
    )


@query("velocity_trend_weekly", "week:d climate_zone:s units_sold:i",
       """SELECT date_trunc('week', sale_date) AS week, climate_zone, SUM(units_sold) AS units_sold FROM silver_sales
WHERE seasonality = 'cold_weather' AND sale_date >= (SELECT MAX(sale_date) FROM silver_sales) - INTERVAL 56 DAYS
GROUP BY 1, 2""")
def velocity_trend_weekly(r: Retail) -> DataFrame:
    return history.velocity_trend(r.silver_sales, affected(), as_of=r.newest).orderBy("week", "climate_zone")


@query("sales_profile", "row_count:i stores:i products:i first_date:d last_date:d",
       """SELECT COUNT(*) AS row_count, COUNT(DISTINCT store_id) AS stores, COUNT(DISTINCT product_id) AS products,
  MIN(sale_date) AS first_date, MAX(sale_date) AS last_date FROM silver_sales""")
def sales_profile(r: Retail) -> DataFrame:
    return history.sales_profile(r.silver_sales)


@query("sales_profile_by_year", "year:i row_count:i stores:i products:i close:b",
       """SELECT year(sale_date) AS year, COUNT(*) AS row_count, COUNT(DISTINCT store_id) AS stores,
  COUNT(DISTINCT product_id) AS products, TRUE AS close FROM silver_sales GROUP BY 1""")
def sales_profile_by_year(r: Retail) -> DataFrame:
    """Sketches per day, united to years; the estimates beside exact counts, close: within 2 %."""
    columns = ["store_id", "product_id"]
    days = sketches.daily_sketches(r.silver_sales, F.col("sale_date"), columns)
    guess = sketches.united(days, columns, F.year("day"), "year").drop("n_rows")
    exact = r.silver_sales.groupBy(F.year("sale_date").alias("year")).agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("store_id").alias("stores"),
        F.countDistinct("product_id").alias("products"),
    )
    close = sketches.within(F.col("store_id"), F.col("stores"), 0.02) & sketches.within(F.col("product_id"), F.col("products"), 0.02)
    return exact.join(guess, "year").withColumn("close", close)


# ---- queue: recommendations and live state

QUEUE_SPEC = (
    "id:s store_id:i store_name:s region:s climate_zone:s city:s store_lat:4 store_lng:4 product_id:i "
    "product_name:s category:s seasonality:s on_hand_units:i on_order_units:i recent_units_7d:i "
    "avg_daily_velocity:4 weeks_of_supply:4 price_usd:2 markdown_risk_score:1 lost_sales_exposure_usd:2 "
    "markdown_exposure_usd:2 position_status:s recommended_move:s predicted_recaptured_usd:2 live_move_type:s "
    "action_status:s"
)


def live_queue(r: Retail, rows: DataFrame) -> DataFrame:
    return queue.with_live_state(rows, r.recommended, r.actions)


@query("live_state_join", QUEUE_SPEC, "SELECT * FROM queue")
def live_state_join(r: Retail) -> DataFrame:
    """Every position, healthy ones too."""
    return live_queue(r, r.position)


@query("position_queue_filter", QUEUE_SPEC,
       f"""SELECT * FROM queue WHERE {OPEN} AND climate_zone = 'North'
ORDER BY lost_sales_exposure_usd DESC NULLS LAST, markdown_exposure_usd DESC NULLS LAST, store_id, product_id LIMIT 300""")
def position_queue_filter(r: Retail) -> DataFrame:
    return queue.top_queue(live_queue(r, r.flagged.where(queue.queue_filter(zone="North"))))


@query("queue_by_status", QUEUE_SPEC,
       """SELECT * FROM queue WHERE position_status = 'overstock' AND category = 'PROMO'
ORDER BY lost_sales_exposure_usd DESC NULLS LAST, markdown_exposure_usd DESC NULLS LAST, store_id, product_id LIMIT 300""")
def queue_by_status(r: Retail) -> DataFrame:
    keep = queue.queue_filter(status="overstock", category="PROMO")
    return queue.top_queue(live_queue(r, r.flagged.where(keep)))


@query("queue_sorted", QUEUE_SPEC,
       f"SELECT * FROM queue WHERE {OPEN} ORDER BY avg_daily_velocity DESC NULLS LAST, store_id, product_id LIMIT 300")
def queue_sorted(r: Retail) -> DataFrame:
    return queue.top_queue(live_queue(r, r.flagged.where(queue.queue_filter())), sort="velocity")


@query("queue_text_search", "store_id:i product_id:i store_name:s city:s product_name:s",
       """SELECT * FROM positions WHERE lower(COALESCE(store_name, '')) LIKE '%gizmo%'
  OR lower(COALESCE(city, '')) LIKE '%gizmo%' OR lower(COALESCE(product_name, '')) LIKE '%gizmo%'
  OR lower(CAST(product_id AS VARCHAR)) LIKE '%gizmo%'""")
def queue_text_search(r: Retail) -> DataFrame:
    return r.position.where(queue.text_filter(" Gizmo "))


@query("recovery_in_progress", QUEUE_SPEC, f"SELECT * FROM queue WHERE {OPEN} AND live_move_type IS NOT NULL")
def recovery_in_progress(r: Retail) -> DataFrame:
    return live_queue(r, r.flagged.where(pos.is_open())).where(queue.in_progress())


@query("kpi_summary",
       "lost_sales_exposure_usd:2 markdown_exposure_usd:2 open_shortfalls:i recoveries_in_progress:i",
       f"""SELECT IFNULL(SUM(lost_sales_exposure_usd), 0) AS lost_sales_exposure_usd, COUNT(*) AS open_shortfalls,
  (SELECT IFNULL(SUM(markdown_exposure_usd), 0) FROM positions WHERE position_status = 'overstock') AS markdown_exposure_usd,
  (SELECT COUNT(*) FROM positions SEMI JOIN acted_keys USING (store_id, product_id) WHERE {OPEN}) AS recoveries_in_progress
FROM positions ANTI JOIN acted_keys USING (store_id, product_id) WHERE {OPEN}""")
def kpi_summary(r: Retail) -> DataFrame:
    return queue.kpi_summary(r.flagged, r.actions)


WORST_KEY = f"(SELECT {{}} FROM shortfalls {WORST} LIMIT 1)"


def worst_key(r: Retail, column: str) -> Column:
    return queue.worst_one(r.flagged.where(pos.is_open())).select(column).scalar()


@query("zero_on_hand_sku",
       "store_id:i product_id:i region:s on_hand_units:i lost_sales_exposure_usd:2 nearest_surplus_store_id:i "
       "nearest_surplus_on_hand:i nearest_surplus_distance_km:1",
       f"""SELECT * FROM shortfalls WHERE on_hand_units = 0
  AND product_id = (SELECT product_id FROM shortfalls WHERE on_hand_units = 0 {WORST} LIMIT 1)
ORDER BY lost_sales_exposure_usd DESC NULLS LAST, store_id LIMIT 10""")
def zero_on_hand_sku(r: Retail) -> DataFrame:
    sold_out = r.flagged.where(F.col("position_status") == "stockout")
    return queue.zero_on_hand(r.shortfalls, queue.worst_one(sold_out).select("product_id").scalar())


@query("position_lookup", QUEUE_SPEC,
       f"SELECT * FROM queue WHERE id = (SELECT CONCAT(store_id, ':', product_id) FROM shortfalls {WORST} LIMIT 1)")
def position_lookup(r: Retail) -> DataFrame:
    wanted = (F.col("store_id") == worst_key(r, "store_id")) & (
        F.col("product_id") == worst_key(r, "product_id")
    )
    return live_queue(r, r.position.where(wanted))


LOOKUP_SPEC = (
    "store_id:i product_id:i store_name:s city:s on_hand_units:i avg_daily_velocity:4 weeks_of_supply:4 "
    "lost_sales_exposure_usd:2 nearest_surplus_store_id:i nearest_surplus_on_hand:i nearest_surplus_distance_km:4"
)


@query("shortfall_lookup", LOOKUP_SPEC,
       f"""SELECT s.*, p.store_name, p.city, p.weeks_of_supply FROM (SELECT * FROM shortfalls {WORST} LIMIT 1) s
LEFT JOIN positions p ON p.store_id = s.store_id AND p.product_id = s.product_id""")
def shortfall_lookup(r: Retail) -> DataFrame:
    return queue.shortfall_lookup(r.shortfalls, r.flagged)


@query("recommendation_lookup",
       "store_id:i product_id:i recommended_move:s recommended_units:i predicted_net_value_usd:2 move:s net:2",
       f"""SELECT r.store_id, r.product_id, r.recommended_move, r.recommended_units, r.predicted_net_value_usd, o.move, o.net
FROM recommended r JOIN move_options o ON o.store_id = r.store_id AND o.product_id = r.product_id
WHERE r.store_id = {WORST_KEY.format('store_id')} AND r.product_id = {WORST_KEY.format('product_id')}""")
def recommendation_lookup(r: Retail) -> DataFrame:
    from shelfwise.sources.tables import parse_move_ranking

    wanted = (F.col("store_id") == worst_key(r, "store_id")) & (
        F.col("product_id") == worst_key(r, "product_id")
    )
    found = r.recommendations.where(wanted).withColumn(
        "option", F.explode(parse_move_ranking(F.col("move_ranking")))
    )
    return found.select("*", "option.move", "option.net")


@query("store_positions", "store_id:i product_id:i position_status:s on_hand_units:i lost_sales_exposure_usd:2 markdown_exposure_usd:2",
       f"""SELECT * FROM positions WHERE store_id = {WORST_KEY.format('store_id')}
ORDER BY lost_sales_exposure_usd DESC NULLS LAST, markdown_exposure_usd DESC NULLS LAST, store_id, product_id LIMIT 50""")
def store_positions(r: Retail) -> DataFrame:
    keep = queue.queue_filter(status_group="all", store=worst_key(r, "store_id"))
    return queue.top_queue(r.position.where(keep), limit=queue.clamp_limit(50, 50))


@query("recovery_portfolio", "recommended_move:s shortfall_count:i total_recaptured_usd:2 total_net_value_usd:2",
       """SELECT recommended_move, COUNT(*) AS shortfall_count,
  SUM(CAST(predicted_recaptured_usd AS DECIMAL(18,2))) AS total_recaptured_usd,
  SUM(CAST(predicted_net_value_usd AS DECIMAL(18,2))) AS total_net_value_usd
FROM recommended GROUP BY recommended_move""")
def recovery_portfolio(r: Retail) -> DataFrame:
    return queue.recovery_portfolio(r.recommended)


@query("recovery_total", "total_recaptured_usd:2",
       "SELECT SUM(CAST(predicted_recaptured_usd AS DECIMAL(18,2))) AS total_recaptured_usd FROM recommended")
def recovery_total(r: Retail) -> DataFrame:
    return r.recommended.agg(F.sum("predicted_recaptured_usd").alias("total_recaptured_usd"))


@query("recommendation_list",
       "store_id:i product_id:i store_name:s product_name:s recommended_move:s recommended_source_store_id:i "
       "predicted_recaptured_usd:2 predicted_net_value_usd:2",
       """SELECT r.*, p.store_name, p.product_name FROM recommended r
JOIN positions p ON p.store_id = r.store_id AND p.product_id = r.product_id""")
def recommendation_list(r: Retail) -> DataFrame:
    return queue.recommendation_list(r.recommendations, r.flagged)
