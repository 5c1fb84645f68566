"""Queries over sales and move history, data quality, and the learned move model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import history, quality, queue, silver
from shelfwise.operators import position as pos
from shelfwise.operators import recovery as rec
from shelfwise.plans.frames import Retail
from shelfwise.plans.metric_queries import OPEN, WORST, affected, worst_key
from shelfwise.plans.registry import query
from shelfwise.sources import fixtures as fx

# ---- history

GRID = """
SELECT k.store_id, k.product_id, CAST(day AS DATE) AS sale_date, COALESCE(units, 0) AS units_sold
FROM (SELECT DISTINCT store_id, product_id FROM {keys}) k
CROSS JOIN (SELECT unnest(generate_series(mx - INTERVAL {back} DAY, mx::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM newest_sale) AS days
LEFT JOIN (SELECT store_id, product_id, sale_date, SUM(units_sold) AS units FROM raw_sales GROUP BY 1, 2, 3) x
  ON x.store_id = k.store_id AND x.product_id = k.product_id AND x.sale_date = CAST(day AS DATE)"""


@query("grid_densify", "store_id:i product_id:i sale_date:d units_sold:i",
       GRID.format(keys=f"positions WHERE {OPEN}", back=59))
def grid_densify(r: Retail) -> DataFrame:
    return history.daily_grid(r.position.where(pos.is_open()), r.sales, 60)


@query("sellthrough_daily", "store_id:i product_id:i sale_date:d units_sold:i",
       GRID.format(keys=f"(SELECT * FROM positions WHERE {OPEN} {WORST} LIMIT 1)", back=27))
def sellthrough_daily(r: Retail) -> DataFrame:
    worst = queue.worst_one(r.position.where(pos.is_open()))
    return history.daily_grid(worst, r.sales, 28).orderBy("sale_date")


@query("traffic_profile", "store_id:i weekday:i avg_traffic:4 avg_units:4 units_per_visitor:4",
       """SELECT t.store_id, t.weekday, avg_traffic, avg_units, avg_units / NULLIF(avg_traffic, 0) AS units_per_visitor
FROM (SELECT store_id, dayofweek(traffic_date) + 1 AS weekday, AVG(traffic_count) AS avg_traffic
  FROM raw_store_traffic GROUP BY 1, 2) t
LEFT JOIN (SELECT store_id, dayofweek(sale_date) + 1 AS weekday, AVG(units) AS avg_units FROM (
    SELECT store_id, sale_date, SUM(units_sold) AS units FROM raw_sales GROUP BY 1, 2) AS daily GROUP BY 1, 2) u
  ON u.store_id = t.store_id AND u.weekday = t.weekday""")
def traffic_profile(r: Retail) -> DataFrame:
    return history.traffic_profile(r.traffic, r.sales)


@query("outcomes_by_move", "move_type:s moves:i avg_recaptured_usd:4 avg_cost_usd:4 recaptured_per_cost:4",
       """SELECT move_type, COUNT(*) AS moves, AVG(recaptured_sales_usd) AS avg_recaptured_usd, AVG(cost_usd) AS avg_cost_usd,
  SUM(recaptured_sales_usd) / NULLIF(SUM(cost_usd), 0) AS recaptured_per_cost FROM transfer_outcomes GROUP BY move_type""")
def outcomes_by_move(r: Retail) -> DataFrame:
    return history.outcomes_by_move(r.outcomes)


@query("learned_coefficients",
       "move_type:s recapture_rate:5 cost_per_unit:4 cost_per_km:4 base_cost:3 margin_loss_rate:5",
       """SELECT move_type, AVG(recaptured_sales_usd / NULLIF(units_moved * CAST(price_usd AS DOUBLE), 0)) AS recapture_rate,
  AVG(cost_usd / NULLIF(units_moved, 0)) AS cost_per_unit, regr_slope(cost_usd, distance_km) AS cost_per_km,
  regr_intercept(cost_usd, distance_km) AS base_cost,
  AVG(margin_impact_usd / NULLIF(units_moved * CAST(price_usd AS DOUBLE), 0)) AS margin_loss_rate
FROM transfer_outcomes GROUP BY move_type""")
def learned_coefficients(r: Retail) -> DataFrame:
    return history.learned_coefficients(r.outcomes)


MOVES = """
SELECT l_suppkey AS from_store_id, o_custkey % (SELECT COUNT(*) FROM supplier) AS to_store_id, l_partkey AS product_id,
  CAST(o_orderdate AS DATE) AS initiated_date FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


@query("asof_move_features",
       "from_store_id:i to_store_id:i product_id:i initiated_date:d from_on_hand_at_move:i to_velocity_at_move:4",
       f"""SELECT a.from_store_id, a.to_store_id, a.product_id, a.initiated_date, a.on_hand_units AS from_on_hand_at_move,
  COALESCE(v.units, 0) / CAST(7 AS DOUBLE) AS to_velocity_at_move
FROM (SELECT m.*, h.on_hand_units FROM (SELECT *, ROW_NUMBER() OVER () AS move_no FROM ({MOVES}) AS plain) m
  ASOF LEFT JOIN (SELECT store_id, product_id, sale_date, MAX(50 - units_sold) AS on_hand_units FROM raw_sales GROUP BY 1, 2, 3) h
  ON h.store_id = m.from_store_id AND h.product_id = m.product_id AND h.sale_date <= m.initiated_date) a
LEFT JOIN (SELECT m.to_store_id, m.product_id, m.initiated_date, SUM(x.units_sold) AS units
  FROM (SELECT DISTINCT to_store_id, product_id, initiated_date FROM ({MOVES}) AS plain) m
  JOIN raw_sales x ON x.store_id = m.to_store_id AND x.product_id = m.product_id
    AND x.sale_date >= m.initiated_date - INTERVAL 7 DAY AND x.sale_date < m.initiated_date
  GROUP BY 1, 2, 3) v
  ON v.to_store_id = a.to_store_id AND v.product_id = a.product_id AND v.initiated_date = a.initiated_date""")
def asof_move_features(r: Retail) -> DataFrame:
    moves = fx.move_log(r.spark, r.sf_dir)
    return history.move_features(moves, fx.stock_history(r.sales), r.sales, tasks=fx.sale_tasks(r.spark, r.sf_dir))


# ---- data quality

DQ = "check_name:s value:4 pass:b"


def checks(body: str, *entries: tuple[str, str, str]) -> str:
    """SQL rows of check_name, value, pass over a one-row body."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, CAST({value} AS DOUBLE) AS value, COALESCE({ok}, FALSE) AS pass FROM ({body}) AS one_row"
        for name, value, ok in entries
    )


@query("dq_hero_shortfall", DQ, checks(
    f"""SELECT MAX(on_hand_units) AS oh, MIN(avg_daily_velocity) AS v, MIN(lost_sales_exposure_usd) AS e,
  MIN(CASE WHEN position_status = 'stockout' THEN 1 ELSE 0 END) AS so
FROM (SELECT * FROM positions WHERE position_status = 'stockout' {WORST} LIMIT 1) AS hero""",
    ("on_hand_is_zero", "oh", "oh = 0"), ("velocity_positive", "ROUND(v, 4)", "v > 0"),
    ("is_stockout", "so", "so = 1"), ("exposure_positive", "ROUND(e, 2)", "e > 0")))
def dq_hero_shortfall(r: Retail) -> DataFrame:
    hero = queue.worst_one(r.flagged.where(F.col("position_status") == "stockout"))
    return quality.hero_shortfall(
        r.flagged, hero.select("store_id").scalar(), hero.select("product_id").scalar()
    )


@query("dq_surplus_covers_need", DQ, checks(
    """SELECT COUNT(*) FILTER (WHERE nearest_surplus_store_id IS NOT NULL) AS a,
  COUNT(*) FILTER (WHERE nearest_surplus_on_hand >= units_needed) AS b FROM economics""",
    ("shortfalls_with_source", "a", "a > 0"), ("sources_that_cover_need", "b", "b = a")))
def dq_surplus_covers_need(r: Retail) -> DataFrame:
    return quality.surplus_covers_need(rec.with_economics(r.shortfalls))


_SHARE = """SELECT CONCAT(grp, '/', position_status) AS check_name, ROUND(CAST(n AS DOUBLE) / total, 6) AS value, {ok} AS pass
FROM (SELECT *, SUM(n) OVER (PARTITION BY grp) AS total FROM (
  SELECT {grp} AS grp, position_status, COUNT(*) AS n FROM positions {where} GROUP BY 1, 2) AS counted) AS shared"""


@query("dq_zone_split", DQ, _SHARE.format(
    grp="climate_zone", where="WHERE seasonality = 'cold_weather'",
    ok=f"NOT (grp = 'South' AND {OPEN}) OR CAST(n AS DOUBLE) / total < 0.5"))
def dq_zone_split(r: Retail) -> DataFrame:
    return quality.zone_split(r.position, affected())


@query("dq_anomaly_confined", DQ, _SHARE.format(
    grp="CASE WHEN seasonality = 'cold_weather' THEN 'affected' ELSE 'other' END", where="",
    ok="NOT (grp = 'other' AND position_status = 'healthy') OR CAST(n AS DOUBLE) / total > 0.5"))
def dq_anomaly_confined(r: Retail) -> DataFrame:
    return quality.anomaly_confined(r.position, affected())


LOST_TARGET, MARKDOWN_TARGET = 4_800_000.0, 5_600_000.0


@query("dq_exposure_band", DQ, checks(
    """SELECT CAST(SUM(lost_sales_exposure_usd) AS DOUBLE) AS l, CAST(SUM(markdown_exposure_usd) AS DOUBLE) AS m FROM positions""",
    ("lost_sales_near_target", "ROUND(l, 2)", f"l BETWEEN {LOST_TARGET} * 0.8 AND {LOST_TARGET} * 1.2"),
    ("markdown_near_target", "ROUND(m, 2)", f"m BETWEEN {MARKDOWN_TARGET} * 0.8 AND {MARKDOWN_TARGET} * 1.2")))
def dq_exposure_band(r: Retail) -> DataFrame:
    return quality.exposure_band(r.position, {"lost_sales": LOST_TARGET, "markdown": MARKDOWN_TARGET})


@query("dq_risk_separates", DQ, checks(
    """SELECT ROUND(AVG(CAST(markdown_risk_score AS DOUBLE)) FILTER (WHERE position_status = 'overstock'), 6) AS o,
  ROUND(AVG(CAST(markdown_risk_score AS DOUBLE)) FILTER (WHERE position_status = 'healthy'), 6) AS h FROM positions""",
    ("overstock_risk_high", "o", "o >= 0.6"), ("healthy_risk_low", "h", "h <= 0.2")))
def dq_risk_separates(r: Retail) -> DataFrame:
    return quality.risk_separates(r.position)


@query("dq_note_dedup", DQ, checks(
    """SELECT COUNT(*) AS n, COUNT(DISTINCT merch_note_text) AS d, (SELECT COUNT(*) FROM note_flags) AS f FROM raw_inventory""",
    ("flags_match_distinct_notes", "f", "f = d"), ("notes_far_fewer_than_rows", "d", "d * 10 < n")))
def dq_note_dedup(r: Retail) -> DataFrame:
    return quality.note_dedup(r.inventory, silver.note_flags(r.inventory))


@query("dq_outcomes_separate", DQ, checks(
    "SELECT " + ", ".join(
        f"ROUND(AVG(recaptured_sales_usd / (units_moved * CAST(price_usd AS DOUBLE))) FILTER (WHERE move_type = '{m}'), 4) AS {m}"
        for m in ("transfer", "expedite", "substitute")) + " FROM transfer_outcomes",
    ("transfer_beats_substitute", "transfer", "transfer > substitute"),
    ("expedite_beats_substitute", "expedite", "expedite > substitute"),
    ("substitute_lowest", "substitute", "substitute < LEAST(transfer, expedite)")))
def dq_outcomes_separate(r: Retail) -> DataFrame:
    return quality.outcomes_separate(r.outcomes)


@query("dq_velocity_ramp", DQ, checks(
    """SELECT SUM(units) FILTER (WHERE week = newest) / NULLIF(AVG(units) FILTER (WHERE week < newest), 0) AS ratio FROM (
  SELECT *, MAX(week) OVER () AS newest FROM (
    SELECT date_trunc('week', sale_date) AS week, SUM(units_sold) AS units FROM silver_sales
    WHERE seasonality = 'cold_weather' AND sale_date >= (SELECT MAX(sale_date) FROM silver_sales) - INTERVAL 56 DAYS
    GROUP BY 1) AS weekly) AS marked""",
    ("no_last_week_cliff", "ROUND(ratio, 4)", "ratio <= 3")))
def dq_velocity_ramp(r: Retail) -> DataFrame:
    return quality.velocity_ramp(history.velocity_trend(r.silver_sales, affected()))


@query("dq_smoke", DQ, checks(
    """SELECT COUNT(*) FILTER (WHERE climate_zone NOT IN ('North', 'South', 'Mixed')) AS z,
  COUNT(*) FILTER (WHERE store_lat IS NULL OR store_lng IS NULL OR store_lat NOT BETWEEN -90 AND 90 OR store_lng NOT BETWEEN -180 AND 180) AS g,
  COUNT(*) FILTER (WHERE position_status NOT IN ('stockout', 'at_risk', 'overstock', 'healthy')) AS s,
  COUNT(*) FILTER (WHERE weeks_of_supply < 0) AS w FROM positions""",
    ("bad_zone", "z", "z = 0"), ("bad_geo", "g", "g = 0"), ("bad_status", "s", "s = 0"),
    ("negative_weeks", "w", "w = 0")))
def dq_smoke(r: Retail) -> DataFrame:
    return quality.smoke(r.position)


@query("dq_pk_unique", DQ, checks(
    """SELECT COUNT(*) AS n FROM (SELECT store_id, product_id FROM positions GROUP BY 1, 2 HAVING COUNT(*) > 1) AS twice""",
    ("repeated_keys", "n", "n = 0")))
def dq_pk_unique(r: Retail) -> DataFrame:
    return quality.pk_unique(r.position)


@query("dq_metric_parity", DQ, checks(
    """SELECT SUM(lost_sales_exposure_usd) AS l, SUM(markdown_exposure_usd) AS m FROM positions WHERE climate_zone = 'North'""",
    ("lost_sales_parity", "ROUND(l, 2)", "TRUE"), ("markdown_parity", "ROUND(m, 2)", "TRUE")))
def dq_metric_parity(r: Retail) -> DataFrame:
    return quality.metric_parity(r.position, F.col("climate_zone") == "North")


@query("dq_move_mix", DQ, checks(
    f"""SELECT COUNT(DISTINCT recommended_move) AS k, SUM(CAST(predicted_recaptured_usd AS DOUBLE)) AS r,
  (SELECT CAST(SUM(lost_sales_exposure_usd) AS DOUBLE) FROM positions WHERE {OPEN}) AS l FROM recommended""",
    ("several_moves", "k", "k > 1"), ("recaptured_within_exposure", "ROUND(r / l, 4)", "r / l <= 1")))
def dq_move_mix(r: Retail) -> DataFrame:
    return quality.move_mix(r.recommendations, r.flagged)


@query("dq_null_scores", DQ, checks(
    "SELECT COUNT(*) FILTER (WHERE markdown_risk_score IS NULL) AS n FROM silver_inventory",
    ("null_scores", "n", "n = 0")))
def dq_null_scores(r: Retail) -> DataFrame:
    return quality.null_scores(r.silver_inventory)
